"""Packing, secrets, licences, quality, decontamination, tokens, surrogates, paragraphs, vectors on small fixtures."""

import base64
import bz2
import gzip
import itertools
import lzma
import os
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from corpusloom.llm import decontaminate, embedding_dedup, license_scan, packing, paragraph_dedup, pii, quality_gam, secret_scan, token_counts
from corpusloom.llm.near_sets import Threshold
from corpusloom.llm.tokenization import default_vocabulary, encoder

SCHEMA = "doc_id long, text string"
EDGES = [(1, None), (2, ""), (3, "one"), (3, "one"), (None, "MIT license and password = hunter22"), (5, "long " * 6000), (6, "Ünï <|endoftext|> 日本 \n\n x")]


def edges(spark, extra=True):
    docs = spark.createDataFrame(EDGES, SCHEMA)
    return docs.selectExpr("doc_id", "text", "'x' AS labels", "1 AS score", "2 AS n_words", "'y' AS rid", "'z' AS node") if extra else docs


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_packing_round_trip(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "Ünï", "x1"]) for _ in range(rng.choice([0, 3, 50, 400, 3000])))) for i in range(60)] + EDGES
    pieces = packing.pack(spark.createDataFrame(rows, SCHEMA)).collect()
    reference = Tokenizer.from_file(default_vocabulary())
    want = sorted(zlib.crc32(np.array([*reference.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")[a : a + 2048].tobytes()) for _, t in rows for a in range(0, len(reference.encode(t or "", add_special_tokens=False).ids) + 1, 2048))
    assert sorted(p["ids_crc32"] for p in pieces) == want
    by = {}
    for p in pieces:
        by.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(p["length"] for p in pieces)
    assert len(by) <= -(-total // 2048) + 1
    assert packing.pack(empty(spark)).count() == 0


def test_closest_subset_is_exact():
    rng = random.Random(2)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(4)}
        room = rng.randint(1, 60)
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * j for s in sums for j in range(n + 1)}
        got = packing.closest_subset(counts, room)
        assert all(n <= counts[k] for k, n in got.items()) and sum(k * n for k, n in got.items()) == max(s for s in sums if s <= room)


def test_secrets(spark):
    nested = base64.b64encode(gzip.compress(b"then password = hunter22 ok")).decode()
    cases = ["token: abcdef", "token: abc", "API_KEY = 'A1b2c3d4'", "AKIA" + "A" * 16, "AKIA" + "A" * 15, "ab12" * 6, f"x {nested} y", "password%3D%22abcdefgh", "\\u0074oken: abcdef1", "K token=token=abcdefgh"]
    got = [secret_scan.scan(c) for c in cases]
    assert [[k for k, _, _ in g[0]] for g in got] == [["assign"], [], ["assign"], ["access"], [], ["hex"], [], [], [], ["assign"]]
    assert got[6][1] == [("base64/inflate/assign", 2, 2 + len(nested))] and got[7][1] == [("url/assign", 0, 22)] and got[8][1] == [("unicode/assign", 0, 19)]
    out = secret_scan.scan_secrets(edges(spark)).collect()
    assert len(out) == len(EDGES) and sum(r["n_assign"] for r in out) == 1
    assert secret_scan.scan_secrets(empty(spark)).count() == 0
    red = secret_scan.redact_secrets(edges(spark))
    assert red.columns == edges(spark).columns and "hunter22" not in str(red.collect())


def test_secret_cycles_end():
    layer = "password=abcdefgh"
    for _ in range(6):
        layer = base64.b64encode(layer.encode()).decode()
    base, added, layers = secret_scan.scan(layer)
    assert layers == 7 and added[-1][0].count("base64/") == 6


def test_secrets_of_repeated_runs_are_all_found(spark):
    """The same run in two places gives two spans, plain, nested and compressed; redaction leaves neither."""
    for run in (b64 := base64.b64encode(b"password=hunter2222").decode(), base64.b64encode(b64.encode()).decode(), base64.b64encode(gzip.compress(b"password=hunter2222")).decode()):
        text = f"x {run} y {run} z"
        spans = [(a, b) for _, a, b in secret_scan.scan(text)[1]]
        assert spans == [(2, 2 + len(run)), (5 + len(run), 5 + 2 * len(run))]
        assert secret_scan.redact_secrets(spark.createDataFrame([(1, text)], SCHEMA)).first()["text"] == "x [SECRET] y [SECRET] z"
    twice = base64.b64encode(f"{b64} and {b64}".encode()).decode()
    assert [s[1:] for s in secret_scan.scan(f"{twice} {b64}")[1]] == [(0, len(twice)), (len(twice) + 1, len(twice) + 1 + len(b64))]


def test_secrets_in_joined_streams_and_behind_names():
    import zstandard

    plain, secret = b"nothing to see here, move along", b"some text password = hunter22 end"
    for pack in (gzip.compress, zlib.compress, bz2.compress, lzma.compress, zstandard.ZstdCompressor().compress):
        run = base64.b64encode(pack(plain) + pack(secret)).decode()
        assert secret_scan.scan(run)[1] == [("base64/inflate/assign", 0, len(run.rstrip("=")) + run.count("="))]
        for name in ("blob_", "a/", "key-x_", "data+", "q"):
            glued = name + base64.b64encode(pack(secret)).decode()
            found = secret_scan.scan(f"x {glued}")[1]
            assert found == [("base64/inflate/assign", 2, 2 + len(glued))] or (name == "q" and pack is zlib.compress)
    for name in ("blob_", "a/", "key-x_", "data+", "q", "ab", "abc"):
        glued = name + base64.b64encode(secret).decode()
        assert secret_scan.scan(f"x {glued}")[1] == [("base64/assign", 2, 2 + len(glued))]
    assert secret_scan.scan("\\U00000074oken: abcdef1")[1] == [("unicode/assign", 0, 23)] and secret_scan.scan("\\u{74}oken: abcdef1")[1] == [("unicode/assign", 0, 19)]


def test_base_spans_match_a_plain_scanner():
    """Against a scanner that tries every place by itself, without hints or least lengths in the patterns."""
    rng = random.Random(21)
    parts = ["password", "PassWD", "secret", "token", "api_key", "APIKEY", "=", ": ", " := ", "'", '"', " ", "AKIA", "AKIAABCD", "0123456789abcdef", "deadbeef", "Zz+/_.-", "x", "\n", "é", "K"]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(40)))
        want = []
        for kind, pattern, group, least in (("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6), ("access", r"(AKIA[A-Z0-9]+)", 1, 20), ("hex", r"([0-9a-f]+)", 1, 24)):
            at = 0
            while at < len(text):
                m = re.compile(pattern, re.ASCII).match(text, at)
                if m and len(m[group]) >= least:
                    want.append((kind, m.start(), m.end()))
                at = m.end() if m else at + 1
        assert sorted(secret_scan.matches(text)) == sorted(want)


def test_nested_layers_at_random(spark):
    """Planted secrets under random layers: each planted place is covered by a span, and redaction leaves no secret."""
    rng = random.Random(31)
    wraps = {
        "url": lambda t: "".join(f"%{b:02X}" for b in t.encode()), "unicode": lambda t: "".join(f"\\u{ord(c):04x}" for c in t), "entity": lambda t: "".join(f"&#{ord(c)};" for c in t),
        "base64": lambda t: base64.b64encode(t.encode()).decode(), "gzip": lambda t: base64.b64encode(gzip.compress(t.encode())).decode(), "lzma": lambda t: base64.b64encode(lzma.compress(t.encode())).decode(),
        "glued": lambda t: "id_" + base64.b64encode(t.encode()).decode(), "twice": lambda t: base64.b64encode(f"see {t} or {t}".encode()).decode(),
    }
    for _ in range(60):
        text, places, used = "", [], []
        for _ in range(rng.randint(1, 4)):
            run = f"password=hunt{rng.randrange(10**6):06d}"
            route = [rng.choice(sorted(wraps)) for _ in range(rng.randint(1, 4))]
            for name in route:
                run = wraps[name](run)
            text += rng.choice([" ", "\n\n", " - "]) + "words "
            for _ in range(rng.randint(1, 2)):
                places.append((len(text), len(text) + len(run), route))
                text += run + " "
        spans = [(a, b) for _, a, b in secret_scan.scan(text)[1]]
        for a, b, route in places:
            assert any(x <= a + 8 and b - 3 <= y for x, y in spans), (route, a, b, spans)


@pytest.mark.parametrize("odd", ["\u00a0", "\u3000", "\u200b", "\u200d", "\f", "\0"])
def test_secrets_beside_odd_characters(odd):
    run = base64.b64encode(f"some{odd}text password = hunter22 end".encode()).decode()
    assert secret_scan.scan(f"x {run} y")[1] == [("base64/assign", 2, 2 + len(run))]


def test_secrets_between_broken_escapes():
    """What can't be decoded in a run of escapes hides nothing beside it."""
    secret = "password = hunter22"
    url, units = "".join(f"%{b:02x}" for b in secret.encode()), "".join(f"\\u{ord(c):04x}" for c in secret)
    for before, after in (("%ff", ""), ("", "%ff"), ("%e2%82", "%c3"), ("%ed%a0%80", "")):
        run = before + url + after
        assert secret_scan.scan(f"x {run} y")[1] == [("url/assign", 2 + len(before), 2 + len(before) + len(url))], run
    for before, after in (("\\ud800", ""), ("", "\\udc00"), ("\\ud800\\ud800", "\\ud800")):
        run = before + units + after
        assert secret_scan.scan(f"x {run} y")[1] == [("unicode/assign", 2 + len(before), 2 + len(before) + len(units))], run


def test_secrets_in_wide_text_and_headless_deflate():
    secret = "some text password = hunter22 end"
    for kind in ("utf-16-le", "utf-16-be"):
        run = base64.b64encode(secret.encode(kind)).decode()
        assert secret_scan.scan(f"x {run} y")[1] == [("base64/utf16/assign", 2, 2 + len(run))]
    bare = zlib.compressobj(9, zlib.DEFLATED, -15)
    run = base64.b64encode(bare.compress(secret.encode()) + bare.flush()).decode()
    assert secret_scan.scan(f"x {run} y")[1] == [("base64/inflate/assign", 2, 2 + len(run))]


def test_memory_of_long_runs_of_escapes():
    """3.3 MB of escapes take less than 150 MB of what Python counts."""
    import tracemalloc

    run = "".join(f"%{b:02x}" for b in b"word " * 220_000 + b"password = hunter22")
    tracemalloc.start()
    found = secret_scan.scan(run)[1]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [("url/assign", len(run) - 57, len(run))] and most < 150 << 20


@pytest.mark.parametrize("width", [64, 75, 76])
@pytest.mark.parametrize("packed", [False, True])
def test_secrets_in_wrapped_base64(spark, width, packed):
    rng = random.Random(width)
    noise = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    for shift in range(48, 70):
        plain = f"{noise(60)[:shift]} password = hunter2222 {noise(60)}".encode()
        flat = base64.b64encode(gzip.compress(plain) if packed else plain).decode()
        for sep in ("\n", "\r\n", "\n  "):
            block = sep.join(flat[k : k + width] for k in range(0, len(flat), width))
            text = f"Title:\n{block}\n\nthe end"
            _, added, _ = secret_scan.scan(text)
            assert added == [("base64/inflate/assign" if packed else "base64/assign", 7, 7 + len(block))]
    red = secret_scan.redact_secrets(spark.createDataFrame([(1, text)], SCHEMA)).first()["text"]
    assert red == "Title:\n[SECRET]\n\nthe end"
    assert secret_scan.scan(f"-----BEGIN X-----\n{block}\n-----END X-----")[1]


@pytest.mark.parametrize("pack", [gzip.compress, zlib.compress, bz2.compress, lzma.compress])
def test_secrets_in_large_compressed_runs(pack):
    """A run that holds more than 16 MiB is scanned to its end, and so is one whose stream is cut off."""
    text = b"line of a log\n" * 1_300_000 + b"password = hunter22\n"
    run = base64.b64encode(pack(text)).decode()
    assert secret_scan.scan(f"x {run} y")[1] == [("base64/inflate/assign", 2, 2 + len(run))]
    headed = base64.b64encode(b"x password = hunter22 end").decode()  # as a zlib stream begins
    assert secret_scan.scan(headed)[1] == [("base64/assign", 0, len(headed))]
    rng = random.Random(4)
    cut = base64.b64encode(pack(b"password = hunter22\n" + rng.randbytes(2_000_000))[:-30]).decode()
    assert secret_scan.scan(f"x {cut} y")[1][0][0] == "base64/inflate/assign"


def test_licenses_match_sql(spark):
    rows = [*EDGES, (8, "This work is licensed under the GNU General Public License, version 3."), (9, "cc by cc-by CC BY-NC 4.0; licensed under CC BY-NC 4.0"), (10, "licensed under the (new) apache license version 2.0"), (11, "All rights reserved.\nK mit liKense")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = license_scan.scan_licenses(docs)
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = con.sql(license_scan.oracle())
    norm = lambda names, ts: sorted(tuple(str(dict(zip(names, t, strict=True))[c]) for c in sorted(names)) for t in ts)
    assert norm(got.columns, map(tuple, got.collect())) == norm(want.columns, want.fetchall())
    assert license_scan.scan_licenses(edges(spark)).count() == len(EDGES) and license_scan.scan_licenses(empty(spark)).count() == 0


def test_quality(spark):
    rng = random.Random(7)
    good = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(80)) + "."
    bad = lambda: " ".join([rng.choice(["SPAM!!", "BUY$$$"])] * 60)
    rows = [(i, good() if i % 2 else bad()) for i in range(300)]
    docs = spark.createDataFrame([*rows, *EDGES], SCHEMA)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(300)], "doc_id long, quality int, toxic int")
    out = quality_gam.score_quality(docs, labels).collect()
    assert len(out) == len(rows) + len(EDGES)
    first = {r["doc_id"]: r for r in out if r["doc_id"] is not None and r["doc_id"] > 6}
    assert all(r["predicted"] == r["doc_id"] % 2 for r in first.values() if r["held_out"]) and all(0 <= r["score"] <= 1 for r in out)
    assert {i: r["held_out"] for i, r in first.items()} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in first}
    none = spark.createDataFrame([], labels.schema)
    assert {r["score"] for r in quality_gam.score_quality(edges(spark), none).collect()} == {0.5}


def test_scores_are_sums_of_table_entries(spark):
    """Each row by itself: the intercept and one entry for each feature and pair."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 5)).round(1)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_gam.fit(x, y, rounds=20, pair_rounds=20)
    got = model.score(x)
    for row, score in zip(x, got, strict=True):
        b = [sum(v >= c for c in cuts) for v, cuts in zip(row, model.cuts, strict=True)]
        z = model.intercept + sum(t[i] for t, i in zip(model.singles, b, strict=True)) + sum(t[b[i], b[j]] for (i, j), t in model.pairs.items())
        assert abs(1 / (1 + np.exp(-z)) - score) < 1e-12
    assert ((got > 0.5) == (y > 0.5)).mean() > 0.9 and model.pairs[0, 1].any()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the supplied tables are not here")
def test_quality_on_held_out_labels(spark):
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet")
    rows = quality_gam.score_quality(read("documents"), read("labels")).where("held_out").join(read("labels"), "doc_id").select("quality", "score").collect()
    good, bad = [r["score"] for r in rows if r["quality"] == 1], [r["score"] for r in rows if r["quality"] == 0]
    assert len(rows) > 50 and np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad]) > 0.95


def test_decontamination(spark):
    rng = random.Random(3)
    words = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    items = [(i, " ".join(words(n))) for i, n in enumerate([30, 30, 60, 12, 3])] + [(9, None), (10, "")]
    near = items[2][1].split()
    near[20] = "changed"
    docs = [(0, " ".join(words(50)) + " " + items[0][1].upper() + " " + " ".join(words(20))), (1, " ".join(words(200))), (2, " ".join([*words(9), *near, *words(9)])), (3, "x " + items[4][1]), (4, items[3][1]), *EDGES[:1]]
    got = decontaminate.find_contamination(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string"))
    want = []
    for d, t in docs:
        w = decontaminate.words_of(t)
        for i, it in items:
            parts = decontaminate.shingles(decontaminate.words_of(it))
            n = len(decontaminate.words_of(it))
            best = max((decontaminate.similarity(decontaminate.shingles(w[s : s + n]), parts) for s in range(max(1, len(w) - n + 1))), default=0) if parts and w else 0
            if best >= 0.8:
                want.append((d, i, round(best, 9)))
    assert sorted((r["doc_id"], r["item_id"], round(r["similarity"], 9)) for r in got.collect()) == sorted(want) and len(want) >= 4
    small = decontaminate.find_contamination(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string"), block_chars=100)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, got.collect()))
    kept = decontaminate.drop_contaminated(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string"))
    assert {r["doc_id"] for r in kept.collect() if r["doc_id"] != 1 or r["text"]} == {1}
    assert decontaminate.find_contamination(edges(spark), spark.createDataFrame([], "item_id long, text string")).count() == 0


@pytest.mark.parametrize("radius", [0, 5, 30, 40, 44])
def test_block_index_finds_all_within_the_radius(radius):
    rng = np.random.default_rng(radius)
    items = rng.integers(0, 2**63, (70, 2), dtype=np.uint64)
    flipped = np.unpackbits(items[rng.integers(70, size=300)].view(np.uint8), axis=1)
    for row in flipped:
        row[rng.permutation(128)[: rng.integers(0, 50)]] ^= 1
    queries = np.concatenate([np.packbits(flipped, axis=1).view(np.uint64), rng.integers(0, 2**63, (300, 2), dtype=np.uint64)])
    index = decontaminate.BlockIndex(items, radius)
    assert sum(t + 1 for t in decontaminate.flips(radius)) == radius + 1 and sum(decontaminate.WIDTHS) == decontaminate.BITS
    d = np.bitwise_count(queries[:, None, :] ^ items[None, :, :]).sum(axis=2)
    assert {(q, i, int(d[q, i])) for q, i in np.argwhere(d <= radius).tolist()} == {tuple(map(int, x)) for x in zip(*index.within(queries), strict=True)}
    assert len(index.candidates(queries)[0]) < queries.shape[0] * 70


def test_contamination_steps(spark):
    """What each step looks at: all windows of the items' sizes, fingerprints of few, comparisons of fewer; and the
    same findings as from comparing every window, for long texts, ties, repeated items and clashing columns."""
    rng = random.Random(17)
    words = lambda n: [f"w{rng.randrange(900)}" for _ in range(n)]
    items = [(i, " ".join(words(n))) for i, n in enumerate([15, 15, 22, 40, 41, 4])]
    items += [(7, items[3][1]), (None, items[0][1]), (0, items[0][1])]
    change = lambda t, k: " ".join(w if j % 17 or not k else "zz" for j, w in enumerate(t.split(), 1))
    texts = [" ".join([*words(40), change(items[rng.randrange(6)][1], k % 3), *words(9), items[k % 6][1].upper() + "!", *words(3000 if k == 5 else 30)]) for k in range(12)]
    texts += [items[3][1] + " and " + items[3][1], " ".join(items[3][1].split()[:38]), "", None, "one", *[" ".join(words(60)) for _ in range(30)]]
    bench = decontaminate.Benchmark([(i, t) for i, t in items], 40, 0.8)
    got = bench.match(texts)
    want = []
    for t in texts:
        w, best = decontaminate.words_of(t), {}
        for i, ws in bench.items:
            for s in range(max(1, len(w) - len(ws) + 1)) if w else []:
                v = decontaminate.similarity(decontaminate.shingles(w[s : s + len(ws)]), decontaminate.shingles(list(ws)))
                if v >= 0.8 and (i not in best or v > best[i][1]):
                    best[i] = (s, v)
        want.append({(i, s, round(v, 9)) for i, (s, v) in best.items()})
    assert [{(m[0], m[1], round(m[4], 9)) for m in found} for found in got] == want and sum(map(len, want)) > 20
    seen = bench.seen
    assert seen["windows"] >= sum(max(1, len(decontaminate.words_of(t)) - 3) for t in texts) and seen["compared"] < seen["fingerprints"] < seen["windows"] / 3
    docs = spark.createDataFrame([(k, t, "x", 3) for k, t in enumerate(texts)], "doc_id long, text string, item_id string, similarity int")
    kept = decontaminate.drop_contaminated(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {k for k, f in enumerate(want) if not f}


def check_tree(tree, text):
    """Every leaf ends where a piece of a full pass ends, and every node holds the sums of those below."""
    ends = [m.end() for m in tree.pattern.finditer(text)]
    leaves = tree._leaves()
    bounds = np.cumsum(leaves[:, 0])
    assert tree.text == text and tree.n_chars == len(text) and tree.n_pieces == len(ends)
    assert [int((np.array(ends) <= b).sum()) for b in bounds] == np.cumsum(leaves[:, 1]).tolist() and set(bounds.tolist()) <= {0, *ends}
    size = len(tree.sums) // 2
    assert all((tree.sums[k] == tree.sums[2 * k] + tree.sums[2 * k + 1]).all() for k in range(1, size))


def test_token_tree_equals_full_pass(spark):
    path, rng = default_vocabulary(), random.Random(5)
    enc, letters = encoder(path), "ab c'st \n\n  12é日本,.!?'ll x"
    for _ in range(200):
        text = "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 50, 400])))
        tree = token_counts.TokenTree.build(text, path, rng.choice([2, 4, 64]))
        for _ in range(5):
            start, length, new = rng.randint(0, max(1, len(text))), rng.choice([0, 1, 20]), "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 30])))
            tree.edit(start, length, new)
            text = text[:start] + new + text[start + length :]
            assert tree.n_tokens == len(enc.fast.encode_ordinary(text))
            check_tree(tree, text)
    big = token_counts.TokenTree.build("word and more " * 3000, path)
    big.edit(20_000, 3, "x")
    assert big.reencoded <= 3 * big.width
    out = token_counts.count_edited(token_counts.sample_edits(edges(spark))).collect()
    assert len(out) == len(EDGES) and all(r["n_edits"] == 4 for r in out)
    assert token_counts.count_edited(token_counts.sample_edits(empty(spark))).count() == 0


def test_trees_are_kept_and_edited_again(spark, tmp_path):
    """A stored table of trees takes edits, is stored, and takes more: the same as a full pass, without one."""
    path = default_vocabulary()
    count = lambda t: len(encoder(path).fast.encode_ordinary(t or ""))
    rows = [(i, f"Line {i} of text. " * 400) for i in range(5)] + [(7, None), (8, ""), (None, "no id"), (5, "twice"), (5, "twice")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], f"{SCHEMA}, version int, chars string")
    token_counts.build_trees(docs).write.parquet(str(tmp_path / "v0"))
    edits = "doc_id long, edits array<struct<start: int, length: int, text: string>>"
    first = spark.createDataFrame([(0, [(100, 5, "changed"), (3000, 0, " more")]), (1, None), (5, [(0, 2, "T")]), (8, [(4, 4, "new text")])], edits)
    one = token_counts.apply_edits(spark.read.parquet(str(tmp_path / "v0")), first)
    one.drop("n_edits", "n_reencoded").write.parquet(str(tmp_path / "v1"))
    two = token_counts.apply_edits(spark.read.parquet(str(tmp_path / "v1")), spark.createDataFrame([(0, [(50, 1, ""), None])], edits))
    for frame, changed in ((one, {0: 2, 5: 1, 8: 1}), (two, {0: 1})):
        got = frame.collect()
        assert len(got) == len(rows) and all(r["tokens"][1] == count(r["text"]) and r["n_edits"] == changed.get(r["doc_id"], 0) for r in got)
        assert sum(r["n_reencoded"] for r in got) < 250 and all(r["n_reencoded"] == 0 for r in got if r["doc_id"] not in changed)
    text = {r["doc_id"]: (r["text"], r["version"]) for r in two.collect()}
    want = rows[0][1][:100] + "changed" + rows[0][1][105:]
    want = want[:3000] + " more" + want[3000:]
    assert text[0] == (want[:50] + want[51:], 2) and text[8] == ("new text", 1) and text[7] == (None, 0)


def test_surrogates(spark):
    text = "Maria Schmidt, +1 (386) 555-3733 or +13865553733, A.b7@mail.example.com / a.b7@mail.example.com, 61.131.143.218, 4111 1111 1111 1111. Schmidt said so. Анна Петрова."
    rows = [(1, text), (2, "again +1 (386) 555-3733"), *EDGES]
    out = {(r["doc_id"], r["n_entities"]): r["text"] for r in pii.pseudonymize(spark.createDataFrame(rows, SCHEMA), "k").collect()}
    new = next(t for (i, n), t in out.items() if i == 1 and n)
    for secret in ("Maria", "Schmidt", "386", "a.b7", "61.131", "4111 1111", "Анна", "Петрова"):
        assert secret not in new
    found = pii.find_entities(new)
    assert [e.kind for e in found][:2] == ["given", "family"] and pii.GENDER[new.split()[0]] == ("latin", "f")
    phones = [e.canonical for e in found if e.kind == "phone"]
    assert len(phones) == 2 and len(set(phones)) == 1 and new.split("card")[0].count("+1 (") == 1
    card = next(e.canonical for e in found if e.kind == "card")
    assert pii._luhn(card[:-1]) == int(card[-1]) and card[0] == "4"
    assert phones[0] in "".join(c for c in next(t for (i, n), t in out.items() if i == 2 and n) if c.isdigit())
    keyed, numbers = pii.Keyed(b"k" * 32), [f"{i:016d}" for i in range(3000)]
    assert len({keyed.surrogate("card", n) for n in numbers}) == 3000 and len({keyed.surrogate("ip", f"{i}.{j}.1.22") for i in range(256) for j in range(20)}) == 5120
    joined = pii.pseudonymize(spark.createDataFrame(rows, SCHEMA), "k", broadcast_rows=-1)
    assert sorted(map(str, joined.collect())) == sorted(map(str, pii.pseudonymize(spark.createDataFrame(rows, SCHEMA), "k").collect()))
    assert pii.pseudonymize(empty(spark), "k").count() == 0


def test_collisions_are_drawn_again(spark, monkeypatch):
    """With surrogates from a tiny range, distinct entities still end up distinct and none is another's original."""

    def tiny(batches):
        for b in batches:
            got = [f"s{int(c.split('.')[-1]) // 2 + a}" for c, a in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.string())], ["kind", "canonical", "attempt", "surrogate"])

    monkeypatch.setattr(pii, "_draw", lambda key: tiny)
    docs = spark.createDataFrame([(i, f"10.0.0.{i}") for i in range(4)], SCHEMA)
    again = {(r["canonical"]): r["attempt"] for r in pii.attempts_needed(docs, b"k", 20).collect()}
    names = [f"s{(int(x.split('.')[-1]) // 2 + again.get(x, 0))}" for x in (f"10.0.0.{i}" for i in range(4))]
    assert len(set(names)) == 4


def test_crowded_classes_stay_distinct(spark):
    """Of a class that the corpus fills, and of one it fills to a third, no two entities share a surrogate and none
    keeps its own; in a wide class no surrogate is another entity."""
    for n in (10_000, 3_000, 40):
        docs = spark.createDataFrame([(i, " ".join(f"{k // 1000}.{k // 100 % 10}.{k // 10 % 10}.{k % 10}" for k in range(i, n, 20))) for i in range(20)], SCHEMA)
        out = {r["doc_id"]: r["text"].split() for r in pii.pseudonymize(docs, "k").collect()}
        pairs = [(old, new) for r in docs.collect() for old, new in zip(r["text"].split(), out[r["doc_id"]], strict=True)]
        assert len({new for _, new in pairs}) == n and all(old != new and re.fullmatch(r"\d(\.\d){3}", new) for old, new in pairs)
        if n == 40:
            assert not {new for _, new in pairs} & {old for old, _ in pairs}
    keyed = pii.Keyed(b"k" * 32)
    for sizes in ([3, 4, 2], [1], [5], [2, 2]):
        every = list(itertools.product(*map(range, sizes)))
        for move in (keyed.permute, keyed.cycle):
            got = [tuple(move(list(v), sizes, "t")) for v in every]
            assert sorted(got) == every
        at, walk = every[0], set()
        while at not in walk:
            walk.add(at)
            at = tuple(keyed.cycle(list(at), sizes, "t"))
        assert len(walk) == len(every)


def test_distinct_and_coreferent_over_a_table(spark):
    """By brute force over many documents: one surrogate for each entity, none shared, none an entity of the corpus."""
    rng = random.Random(9)
    names = [f"{a}{b}{c}son" for a in ("Bra", "Klo", "Mer", "Tan") for b in ("da", "lo", "mi") for c in ("", "ric", "tan")]
    firsts = ["Maria", "Anna", "John", "Wei", "Fatima", "Jean"]
    people = [(rng.choice(firsts), n) for n in names]
    mails = [f"{rng.choice('abcdef')}{k}.{rng.choice('xyz')}@{rng.choice(['mail', 'work', 'corp'])}.example{k % 3}.org" for k in range(80)]
    phones = [f"555-{rng.randrange(200, 999)}-{k:04d}" for k in range(90)] + [f"555{rng.randrange(200, 999)}{9000 + k}" for k in range(20)]
    rows = []
    for i in range(60):
        who = rng.sample(people, 3)
        parts = [f"{f} {n} met" for f, n in who] + [f"Mr {who[0][1]} said"] + rng.sample(mails, 3) + rng.sample(phones, 3)
        rng.shuffle(parts)
        rows.append((i, " ; ".join(parts)))
    out = {r["doc_id"]: r["text"] for r in pii.pseudonymize(spark.createDataFrame(rows, SCHEMA), "k").collect()}
    seen: dict[tuple, set] = {}
    for i, text in rows:
        at = 0
        found = pii.find_entities(text)
        new, pieces = out[i], []
        for e, after in zip(found, [*found[1:], None], strict=True):
            gap = text[e.end : after.start if after else len(text)]
            start = e.start + at
            stop = new.index(gap, start + 1) if gap else len(new)
            pieces.append(new[start:stop])
            at += (stop - start) - (e.end - e.start)
            seen.setdefault((e.kind, e.canonical), set()).add("".join(c for c in pieces[-1].lower() if c.isalnum() or c in "@.") if e.kind in ("email", "phone") else pieces[-1].lower())
    assert all(len(v) == 1 for v in seen.values()) and len(seen) > 150
    for kind in ("email", "phone", "family", "given"):
        new = [next(iter(v)) for (k, _), v in seen.items() if k == kind]
        assert len(set(new)) == len(new) and not set(new) & {c.lower() for k, c in seen if k == kind}
    assert {k for k, _ in seen} == {"email", "phone", "family", "given"} and all(pii.gender_of(next(iter(v)).capitalize()) == pii.GENDER[c] for (k, c), v in seen.items() if k == "given")


def test_many_entities_in_one_text():
    text = " ".join(f"10.{k // 65536 % 256}.{k // 256 % 256}.{k % 256}" for k in range(100_000))
    began = time.time()
    assert len(pii.find_entities(text)) == 100_000 and time.time() - began < 20
    assert [e.canonical for e in pii.find_entities("Jean van der Berg met Wei Zhang and Fatima Al-Sayed") if e.kind == "family"] == ["berg", "zhang", "al-sayed"]


def test_paragraphs_and_passages(spark):
    rng = random.Random(6)
    words = lambda n: [f"v{rng.randrange(9000)}" for _ in range(n)]
    shared, passage = words(80), words(60)
    near = list(shared)
    near[40] = "other"
    docs = [(1, " ".join(words(60)) + "\n" + " ".join(shared)), (2, " ".join(near) + "\nshort line"), (3, " ".join([*words(70), *passage, *words(30)])), (4, " ".join([*words(11), *passage, *words(64)])), (5, " ".join(words(300))), (None, " ".join(shared)), *EDGES[:3]]
    got = paragraph_dedup.find_repeats(spark.createDataFrame(docs, SCHEMA)).collect()
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in got if r["kind"] == "paragraph"} == {(1, 1, True), (2, 1, False)}
    assert {(r["doc_id"], r["component_id"]) for r in got if r["kind"] == "passage"} >= {(3, 3), (4, 3)} and 5 not in {r["doc_id"] for r in got}
    assert paragraph_dedup.find_repeats(empty(spark)).count() == 0


def test_passages_repeat_within_a_document(spark):
    """Each later place is a copy, in the same or another document; text that overlaps its own copy is not."""
    rng = random.Random(13)
    words = lambda n: [f"v{rng.randrange(9000)}" for _ in range(n)]
    twice, alone = words(60), words(60)
    docs = [(1, [*words(20), *twice, *words(30), *twice]), (2, [*words(5), *twice, *words(9), *twice, *words(7)]), (3, [*alone, *words(10), *alone]), (4, ["long"] * 300), (5, words(300))]
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], SCHEMA)
    got = paragraph_dedup.repeated_passages(frame).collect()
    spans = sorted((r["doc_id"], r["first_word"], r["n_words"], r["component_id"], r["kept"]) for r in got)
    at = {1: [20, 110], 2: [5, 74], 3: [0, 70]}
    for doc, places in at.items():
        for k, start in enumerate(places):
            own = [s for s in spans if s[0] == doc and start <= s[1] and s[1] + s[2] <= start + 60]
            assert len(own) == 1 and own[0][2] >= 40 and own[0][3] == min(doc, 3 if doc == 3 else 1) and own[0][4] == (k == 0 and doc != 2)
    assert [s[1:] for s in spans if s[0] == 4] == [(0, 40, 4, True), (40, 260, 4, False)] and len(spans) == 8
    rows = [(1, 4, 0), (1, 4, 20), (1, 4, 45), (1, 6, 3), (2, 4, 7), (2, 4, 9), (3, 5, 0), (3, 6, 0)]
    out = paragraph_dedup.repeated_places(spark.createDataFrame(rows, "print long, doc_id long, pos int"), 40).collect()
    assert sorted(map(tuple, out)) == [(4, 0, 4, True), (4, 45, 4, False), (5, 0, 5, True), (6, 0, 5, False), (6, 3, 4, False)]


def test_short_paragraphs_match_brute_force(spark):
    """Lines of five words or more are paragraphs: equal and near copies below and across fifty words are found."""
    rng = random.Random(12)
    words = lambda n: [f"v{rng.randrange(9000)}" for _ in range(n)]
    lines = [" ".join(words(n)) for n in (1, 4, 5, 7, 8, 12, 15, 30, 49, 51)]
    docs = {1: lines, 2: [" ".join(words(20)), *lines], 3: [lines[8] + " one two"], 4: [" ".join(lines[9].split()[:-2])], 5: [lines[4] + " more"], 6: [lines[3] + " more"]}
    units = [(d, n, line.split()) for d, ls in docs.items() for n, line in zip(np.cumsum([0, *(len(x.split()) for x in ls)]).tolist(), ls, strict=False) if len(line.split()) >= 5]
    sets, parent = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for _, _, w in units], list(range(len(units)))
    for i in range(len(units)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                parent = [parent[j] if p == parent[i] else p for p in parent]
    want = set()
    for k, (d, first, w) in enumerate(units):
        group = [units[m][:2] for m in range(len(units)) if parent[m] == parent[k]]
        if len(group) > 1:
            want.add((d, first, len(w), min(group)[0], (d, first) == min(group)))
    got = paragraph_dedup.repeated_paragraphs(spark.createDataFrame([(i, "\n".join(ls)) for i, ls in docs.items()], SCHEMA))
    assert {(r["doc_id"], r["first_word"], r["n_words"], r["component_id"], r["kept"]) for r in got.collect()} == want and len(want) == 19
    assert [n for n in range(1, 9) if Threshold(80, 100).stands_alone(n)] == [1, 2, 3]


def test_passages_are_kept_by_their_first_holder(spark):
    """Document 2 holds a passage of document 1 within a longer text of its own, which document 3 copies."""
    rng = random.Random(11)
    words = lambda n: [f"v{rng.randrange(9000)}" for _ in range(n)]
    old, before, after = words(60), words(100), words(100)
    long = [*before, *old, *after]
    texts = {1: [*words(30), *old, *words(30)], 2: long, 3: [*words(17), *long]}
    got = paragraph_dedup.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], SCHEMA)).collect()
    spans = [(r["doc_id"], r["first_word"], r["n_words"], r["kept"]) for r in got]
    prints = {i: set(map(tuple, (w[k : k + 40] for k in range(len(w) - 39)))) for i, w in texts.items()}
    kept = {}
    for doc, start, n, own in spans:
        for k in range(start, start + n - 39):
            window = tuple(texts[doc][k : k + 40])
            assert sum(window in p for p in prints.values()) > 1
            if own:
                kept.setdefault(window, set()).add(doc)
    assert {r["component_id"] for r in got if r["doc_id"] == 3} == {1, 2} and all(r["kept"] == (r["component_id"] == r["doc_id"]) for r in got)
    assert {d for ds in kept.values() for d in ds} == {1, 2} and all(len(ds) == 1 for ds in kept.values())
    assert kept[tuple(before[20:60])] == {2} and kept[tuple(after[20:60])] == {2} and kept[tuple(old[10:50])] == {1}
    left = [w for d, ws in texts.items() for k, w in enumerate(ws) if not any(d == e and a <= k < a + n and not own for e, a, n, own in spans)]
    assert set(left) == {w for ws in texts.values() for w in ws}


def test_link_exact_sides():
    sets = [np.arange(10, dtype=np.uint64), np.arange(10, dtype=np.uint64), np.arange(5, 30, dtype=np.uint64)]
    forest = paragraph_dedup.link_exact(sets, Threshold(80, 100), [True, True, False])
    assert forest.find(0) != forest.find(1)


@pytest.mark.parametrize(("chunk", "bucket"), [(512, 1024), (3, 4)])
def test_vectors_match_brute_force(spark, chunk, bucket):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((12, 16))
    vectors = [(int(i), (base[i % 12] + rng.standard_normal(16) * rng.choice([0, 0.05, 0.09])).tolist(), int(i % 3)) for i in range(90)]
    odd = [(200, None, 1), (201, [0.0] * 16, 1), (202, [float("nan")] * 16, 1), (203, vectors[0][1], None), (204, [None] * 16, 1), (205, [], 1), (0, vectors[0][1], 0), (None, vectors[3][1], 0)]
    rows = vectors + odd
    got = embedding_dedup.dedup_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), chunk=chunk, bucket=bucket)
    good = [k for k, (_, v, l) in enumerate(rows) if v and l is not None and None not in v and np.isfinite(v).all() and any(v)]
    links, parent = {k: 0 for k in range(len(rows))}, list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in good:
        for j in good:
            a, b = np.array(rows[i][1]), np.array(rows[j][1])
            if i < j and rows[i][2] == rows[j][2] and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.93:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    least = {}
    for k, (v, _, _) in enumerate(rows):
        least.setdefault(find(k), []).append(v)
    name = {r: min((v for v in vs if v is not None), default=None) for r, vs in least.items()}
    want = sorted(str((v, links[k], name[find(k)], v == name[find(k)])) for k, (v, _, _) in enumerate(rows))
    assert sorted(str(tuple(r)) for r in got.collect()) == want
    assert embedding_dedup.dedup_embeddings(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_estimates_leave_no_link_out():
    """Estimates are right on average, no pair at the threshold is ruled out, and few others are recomputed."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((400, 64))
    x[200:] = x[:200] + rng.standard_normal((200, 64)) * 0.35
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    codes, exact = embedding_dedup.Codes.of(x, 256, 20), x @ x.T
    error = embedding_dedup.estimates(codes, codes, 256, 20) - exact
    assert abs(error.mean()) < 2e-3 and np.abs(error[~np.eye(400, dtype=bool)]).std() < 0.06
    open_ = embedding_dedup.undecided(codes, codes, 0.93, 256, 6.0, 20)
    assert open_[exact >= 0.93].all() and (exact >= 0.93).sum() > 500 and open_[exact < 0.8].mean() < 1e-3
    assert codes.signs.nbytes + codes.factor.nbytes + codes.rounded.nbytes + codes.scale.nbytes == 400 * (32 + 4 + 64 + 4)


def test_vectors_of_large_labels_match_all_pairs(spark):
    """Labels of several buckets, a crowd of near copies among them, against all pairs in double precision."""
    rng = np.random.default_rng(12)
    base = rng.standard_normal((500, 24))
    rows = [(int(i), (base[i % 500] + rng.standard_normal(24) * 0.12 * (i % 3)).astype(np.float32).tolist(), int(i % 500 < 50)) for i in range(1500)]
    rows += [(2000 + i, (base[0] + rng.standard_normal(24) * 0.1).astype(np.float32).tolist(), 1) for i in range(150)]
    got = embedding_dedup.dedup_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), bucket=64, chunk=40)
    x, label = np.array([v for _, v, _ in rows], dtype=np.float64), np.array([k for _, _, k in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.93) & (label[:, None] == label[None, :]) & ~np.eye(len(x), dtype=bool)
    want = {v: int(n) for (v, _, _), n in zip(rows, near.sum(axis=1), strict=True)}
    assert {r["vec_id"]: r["n_links"] for r in got.collect()} == want and sum(want.values()) > 20_000
