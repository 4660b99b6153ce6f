import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import near_sets, ngram_join
from corpusloom.llm.components import Forest, components
from corpusloom.llm.near_sets import Threshold, may_link, narrowed, sketch, sketch_bits
from corpusloom.llm.textkit import shingle_sets

SCHEMA = "doc_id long, text string"


def brute(rows, k=4, num=85, den=100):
    """(shingles, component) of each row by comparing all pairs."""
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append(frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)] if words else []))
    forest = Forest()
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * common >= num * len(sets[i] | sets[j]):
                forest.join(i, j)
    ids: dict[int, list] = {}
    for i, (doc, _) in enumerate(rows):
        ids.setdefault(forest.find(i), []).append(doc)
    name = {r: min((x for x in v if x is not None), default=None) for r, v in ids.items()}
    return sorted(((d, len(s), name[forest.find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def families(seed=3, groups=5, members=14, words=60):
    rng, rows = random.Random(seed), []
    for g in range(groups):
        base = [f"w{rng.randrange(4000)}" for _ in range(words)]
        for _ in range(members):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    return rows


def joined(spark, rows, **how):
    out = ngram_join.join_near(spark.createDataFrame(rows, SCHEMA), **how).collect()
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out), key=str)


EDGES = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE  Two"), (6, "one two three"), (7, "a b c d e f g"), (7, "a b c d e f g"),
    (None, "a b c d e f g"), (None, "q r s t u"), (9, "long " * 5000), (10, "long " * 9000), (11, "Ünï cödé tèxt hére now"), (12, "ünï cödé tèxt hére now"),
]


def test_edge_rows(spark):
    assert joined(spark, EDGES) == brute(EDGES)


def test_families_match_brute_force(spark):
    rows = families()
    assert joined(spark, rows) == brute(rows)


def test_chunks_and_second_round_match_brute_force(spark, monkeypatch):
    """Small chunks send blocks through hub chunks, sketches across chunks and pairs; lists are cut too."""
    rows = families(seed=8, groups=3, members=24)
    real = near_sets.set_components
    monkeypatch.setattr(ngram_join, "set_components", lambda *a, **k: real(*a, **k, sketch_sets=5))
    assert joined(spark, rows, chunk_sets=3) == brute(rows)


def test_long_lists_meet_in_a_hub(spark, monkeypatch):
    """Families far longer than a list's chunk, common tokens dealt by node, and lists of unlike nodes."""
    rows = families(seed=5, groups=2, members=70, words=40)
    rng = random.Random(4)
    rows += [(1000 + k, " ".join(["the same five words stand", *(f"y{rng.randrange(10**6)}" for _ in range(3))])) for k in range(40)]
    real = near_sets.set_components
    monkeypatch.setattr(ngram_join, "set_components", lambda *a, **k: real(*a, **k, sketch_sets=6, sample=1, common_seen=12))
    assert joined(spark, rows, chunk_sets=7, common_rows=5) == brute(rows)


def test_order_and_steps_of_the_trie():
    """Prefixes and tries use one order, and each step leaves fewer pairs."""
    rng, limit = np.random.default_rng(6), Threshold(85, 100)
    shared = rng.integers(0, 2**63, 60, dtype=np.uint64)
    sets = [np.unique(np.concatenate([shared[rng.random(60) < 0.95], rng.integers(0, 2**63, 4, dtype=np.uint64)])) for _ in range(30)] + [np.unique(rng.integers(0, 2**63, 50, dtype=np.uint64)) for _ in range(30)]
    values, counts = np.unique(np.concatenate(sets), return_counts=True)
    top = values[np.lexsort((values, -counts))][:60]
    by_hash = np.argsort(top)
    order = ngram_join.Order(top[by_hash], by_hash)
    place = order.from_the_end(values)
    rank = {v: len(values) - 1 - p for v, p in zip(values.tolist(), place.tolist(), strict=True)}
    for s in sets:
        assert order.prefix(s, 9).tolist() == sorted(s.tolist(), key=rank.get)[:9] and sorted(order.prefix(s, len(s)).tolist()) == s.tolist()
    plain, seen = ngram_join.link_within(sets, limit), Counter()
    ordered = ngram_join.link_within(sets, limit, None, order, seen)
    assert all((plain.find(i) == plain.find(j)) == (ordered.find(i) == ordered.find(j)) for i in range(60) for j in range(i))
    assert seen["pairs"] == 60 * 59 > seen["hoped"] > seen["summed"] >= seen["linked"] > 0


def test_empty_table_and_clashing_columns(spark):
    assert joined(spark, []) == []
    rows = [(1, "a b c d e f", "x", 5), (2, "a b c d e f", "y", 6)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, node string, component_id int")
    out = ngram_join.join_near(docs)
    assert out.columns == ["doc_id", "n_shingles", "component_id"]
    assert [tuple(r) for r in out.orderBy("doc_id").collect()] == [(1, 3, 1), (2, 3, 1)]


def test_keep_one(spark):
    rows = [(3, "a b c d e f g"), (1, "a b c d e f g"), (1, "a b c d e f g"), (2, None), (None, "a b c d e f g"), (5, "other words stand in this one")]
    clashing = spark.createDataFrame([(*r, 7, "x") for r in rows], f"{SCHEMA}, _copy int, gone_id string")
    assert sorted(ngram_join.keep_one(clashing).columns) == sorted(clashing.columns) and ngram_join.keep_one(clashing).where("_copy = 7").count() == 4
    kept = ngram_join.keep_one(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text"]
    assert sorted((tuple(r) for r in kept.collect()), key=str) == sorted([(1, "a b c d e f g"), (2, None), (None, "a b c d e f g"), (5, "other words stand in this one")], key=str)


@pytest.mark.parametrize("sides", [False, True])
def test_trie_equals_pairs(sides):
    rng, limit = np.random.default_rng(5), Threshold(85, 100)
    for _ in range(60):
        base = [rng.integers(0, 2**63, n, dtype=np.uint64) for n in (1, 7, 40, 150)]
        sets = []
        for _ in range(24):
            b = base[rng.integers(4)]
            x = np.unique(np.concatenate([b[rng.random(len(b)) < rng.choice([1, 0.97, 0.92])], rng.integers(0, 2**63, rng.integers(3), dtype=np.uint64)]))
            sets += [x] if len(x) else []
        side = [bool(rng.integers(2)) for _ in sets] if sides else None
        got, want = ngram_join.link_within(sets, limit, side), Forest()
        for i in range(len(sets)):
            for j in range(i):
                common = len(np.intersect1d(sets[i], sets[j]))
                if 100 * common >= 85 * (len(sets[i]) + len(sets[j]) - common) and (side is None or side[i] != side[j]):
                    want.join(i, j)
        assert all((got.find(i) == got.find(j)) == (want.find(i) == want.find(j)) for i in range(len(sets)) for j in range(i))


def test_sketches_never_rule_out_a_link():
    rng, limit = np.random.default_rng(9), Threshold(80, 100)
    for n in (3, 20, 90, 700):
        for _ in range(40):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.93], rng.integers(0, 2**63, n // 20, dtype=np.uint64)]))
            common = len(np.intersect1d(a, b))
            x, y = sketch(a, sketch_bits(len(a))), sketch(b, sketch_bits(len(b)))
            w = min(len(x), len(y))
            may = may_link(narrowed(x, w)[None], np.array([len(a)]), narrowed(y, w)[None], np.array([len(b)]), limit)[0, 0]
            assert may or 100 * common < 80 * (len(a) + len(b) - common)


def test_components_of_long_chains(spark):
    rng = random.Random(1)
    ids = rng.sample(range(10**6), 400)
    edges = [(a, b) for a, b in zip(ids[:300], ids[1:300], strict=False)] + [(ids[300], ids[350]), (ids[350], ids[399])]
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert len({got[i] for i in ids[:300]}) == 1 and got[ids[300]] == got[ids[399]] != got[ids[0]] and len(got) == 303


def test_shingles_do_not_depend_on_the_batch():
    texts = ["a b c d e", None, "", "a b c d e", "A  B\tC\nD e"]
    sets = [s.tolist() for _, s in shingle_sets(pa.array(texts), 4)]
    assert sets[0] == sets[3] == sets[4] and sets[1] == sets[2] == []


def test_filter_grows_with_its_places_and_stays_small(spark):
    """Places that filled up 4 MB took 128 MB at once, several times over, through the driver."""
    held = bytearray(np.packbits(np.random.default_rng(1).random(1 << 16) < 0.2).tobytes())
    assert near_sets.bits_needed(bytearray(8192), 28) == 16 and near_sets.bits_needed(held, 28) == 17 and near_sets.bits_needed(bytearray(b"\xff" * 8192), 28) == 23
    places = spark.range(6000).selectExpr("xxhash64(id) as ref", "int(id % 3) as line")
    bits, bitmap = near_sets.member_filter(places, least=15, most=18)
    assert bits == 16 and len(bitmap) == 1 << 13 and near_sets.member_filter(places, least=15, most=15)[0] == 15
    for r in places.collect():
        at = (r["ref"] ^ (r["line"] * near_sets.STEP)) & ((1 << bits) - 1)
        assert bitmap[at >> 3] >> (at & 7) & 1
    assert near_sets.member_filter(places.limit(0), least=15)[0] == 15


def test_components_take_few_exchanges(spark):
    """A round took nine exchanges; stars that are whole end in one round, and ids may be binary."""
    edges = spark.createDataFrame([(bytes([9]), bytes([1])), (bytes([2]), bytes([9])), (bytes([200]), bytes([150]))], "a binary, b binary")
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    got = {bytes(r["id"]): bytes(r["root"]) for r in components(edges).collect()}
    assert got == {bytes([k]): bytes([v]) for k, v in {9: 1, 1: 1, 2: 1, 200: 150, 150: 150}.items()}
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - before < 40


@pytest.mark.parametrize("seed", range(3))
def test_components_match_a_forest(spark, seed):
    rng = random.Random(seed)
    edges = [(a, b) for a, b in ((rng.randrange(120), rng.randrange(120)) for _ in range(90)) if a != b] + [(k, k + 1) for k in range(1000, 1040)]
    forest = Forest()
    for a, b in edges:
        forest.join(a, b)
    out = components(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()
    assert len(out) == len({r["id"] for r in out}) and {r["id"]: r["root"] for r in out} == {x: forest.find(x) for e in edges for x in e}


def test_stars_lead_to_their_least_node():
    """From a centre of the largest id every edge led up out of one id, so all of them met in one task."""
    got = near_sets.stars([9, 4, 7, 4, 5, 6], [(1, 0), (2, 0), (3, 0), (5, 4)])
    assert sorted(got) == [(6, 5), (7, 4), (9, 4)]
