"""Fill-in-the-middle and the audit of sources, against plain loops over small tables."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import fill_in_middle as fim
from corpusloom.llm import source_audit

SCHEMA = "doc_id long, text string, lang string, source string"
CLASH = ["'x' AS n", "1 AS units", "'y' AS form", "2 AS term", "3 AS digest", "'z' AS p0", "4 AS rank", "'w' AS item"]


def texts(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", *CLASH)


def arranged(doc_id, text, seed=7, rate=100, spm=50):
    text, h = text or "", hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return (doc_id, n, "plain", None, None, text)
    if h4 % 100 < spm:
        return (doc_id, n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}")
    return (doc_id, n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}")


def fim_rows():
    rng = random.Random(5)
    parts = ["one\n", "\n", "Ünï 日本\n", "tail", "\r\n", " < P>", "<", "S>", "a b\n", "😀\n", "\x00\n"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(12)))) for i in range(200)]
    rows += [(300, None), (301, ""), (None, "a\nb\nc"), (302, "x<M>y\nz"), (303, "line " * 100_000), (304, "l\n" * 50_000), (305, "same\ntext\n"), (305, "same\ntext\n"), (-7, "n\nm\n")]
    return [(i, t, "en", "s") for i, t in rows]


@pytest.mark.parametrize("rate,spm", [(100, 50), (40, 100), (0, 50), (100, 0)])
def test_arrangements_and_their_restoring(spark, rate, spm):
    rows = fim_rows()
    made = fim.fill_in_middle(texts(spark, rows), rate=rate, spm=spm)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r) for r in made.collect()), key=key) == sorted((arranged(i, t, 7, rate, spm) for i, t, *_ in rows), key=key)
    back = made.select("doc_id", fim.restored(F.col("form"), F.col("output")).alias("text")).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in back) == sorted((str(i), t or "") for i, t, *_ in rows)


def test_sentinels_of_ones_own(spark):
    made = fim.fill_in_middle(texts(spark, [(i, "a|b.\n(c)\n[d", "en", "s") for i in range(20)]), sentinels=("[pre]", "(suf)", ".mid|"))
    back = made.select(fim.restored(F.col("form"), F.col("output"), ("[pre]", "(suf)", ".mid|")).alias("text")).distinct().collect()
    assert [r["text"] for r in back] == ["a|b.\n(c)\n[d"]
    for bad in (("<P>", "<P>", "<M>"), ("<P>", "<P>x", "<M>"), ("aba", "c", "d"), ("xy", "yz", "w"), ("", "b", "c")):
        with pytest.raises(ValueError):
            fim.fill_in_middle(texts(spark, []), sentinels=bad)


def test_fim_sql_and_empty_table(spark, tmp_path):
    docs = texts(spark, [r for r in fim_rows() if "\x00" not in (r[1] or "")])
    docs.coalesce(1).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    want = con.sql(fim.oracle())
    got = fim.digests(fim.fill_in_middle(docs))
    assert got.columns == want.columns
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want.fetchall()))
    assert fim.digests(fim.fill_in_middle(texts(spark, []))).count() == 0


def test_fim_stays_in_the_jvm_without_a_shuffle(spark):
    plan = fim.digests(fim.fill_in_middle(texts(spark, fim_rows())))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def audited(rows, least=30, smoothing=5, top=50):
    docs = [((lang or ""), (source or ""), re.findall(source_audit.TERM, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for *_, words in mine for t in set(words))
        kept = [t for t in df if df[t] >= least]
        v = len(kept)
        counts = {s: Counter(t for _, source, words in mine if source == s for t in words if df[t] >= least) for s in {d[1] for d in mine}}
        every = sum(counts.values(), Counter())
        p = lambda c, t: 1 + 1_000_000_000 * (c[t] + smoothing) // (sum(c.values()) + smoothing * v)
        for s, c in counts.items():
            pairs = [(o, sum(abs(p(c, t) - p(counts[o], t)) for t in kept)) for o in counts if o != s]
            terms = [(t, p(c, t) - p(every, t)) for t in kept if c[t] and p(c, t) > p(every, t)]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(ranked, 1)]
    return sorted(out)


def audit_rows(n=400, sources=9):
    rng = random.Random(11)
    words = ["Alpha", "beta", "GAMMA", "ünï", "日本", "d1e2", "é", "Z", "zz", "rare1", "K"] + [f"w{chr(97 + k)}" for k in range(20)]
    rows = [(i, " ".join(rng.choice(words[: 5 + (i % sources) * 3]) for _ in range(rng.randrange(1, 30))), rng.choice(["en", "de"]), f"s{min(i % sources, rng.randrange(sources))}") for i in range(n)]
    return rows + [(None, None, None, None), (1, "", "", "x"), (2, "123 !", "en", "no terms"), (3, "lonely", "fr", "one"), (4, "alpha " * 20_000, "en", "s1"), (5, "beta", "en", None), (5, "beta", "en", None)]


@pytest.mark.parametrize("kw", [{}, {"held": 7}])
def test_counts_are_the_same_however_often_given_out(spark, kw):
    rows = audit_rows(60)
    got = source_audit.term_counts(texts(spark, rows).repartition(3), piece=5, **kw).collect()
    want = Counter()
    docs = Counter()
    for _, text, lang, source in rows:
        found = re.findall(source_audit.TERM, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        want.update((lang or "", source or "", t) for t in found)
        docs.update((lang or "", source or "", t) for t in set(found))
    assert {(r["lang"], r["source"], r["term"]): (r["occurrences"], r["docs"]) for r in got} == {k: (want[k], docs[k]) for k in want}
    assert len(got) == len(want)


@pytest.mark.parametrize("kw,plain", [({}, {}), ({"side": 3, "rows_a_task": 4, "least_docs": 2, "top_terms": 3, "smoothing": 1}, {"least": 2, "top": 3, "smoothing": 1}), ({"least_docs": 10_000}, {"least": 10_000})])
def test_audit_against_every_pair_and_term(spark, kw, plain):
    rows = audit_rows()
    got = source_audit.audit_sources(texts(spark, rows).repartition(5), **kw)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == audited(rows, **plain)


def test_audit_of_an_empty_table(spark):
    assert source_audit.audit_sources(texts(spark, [])).collect() == []


def test_audit_sql(spark, tmp_path):
    docs = texts(spark, audit_rows())
    docs.coalesce(1).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    assert sorted(con.sql(source_audit.oracle()).fetchall()) == sorted(tuple(r) for r in source_audit.audit_sources(docs).collect())
