"""Multi-index hashing against every pair of small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import hash_search as hs
from corpusloom.llm.queries import op12_hash_search

SCHEMA = "vec_id long, embedding array<float>"


def table(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema).selectExpr("*", "'x' AS h1", "1 AS q1", "2 AS code", "'y' AS rank", "3 AS score", "4 AS query_id", "5 AS place")


def points(n, dims, seed, copies=0.3):
    """Directions without structure, a crowd of near copies and some equal vectors."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dims))
    crowd = int(n * copies)
    x[:crowd] = x[0] + 0.05 * rng.standard_normal((crowd, dims))
    x[crowd : crowd + 12] = x[crowd]
    return x.astype(np.float32)


def brute(rows, asked, k):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], dtype=np.float64)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    out = {}
    for q in asked:
        s = u @ u[q]
        order = sorted((j for j in range(len(ids)) if j != q), key=lambda j: (-round(s[j], 12), ids[j]))[:k]
        out[int(ids[q])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


@pytest.mark.parametrize("n,dims,kw", [(1500, 16, {}), (1500, 64, {"sample_rows": 300, "cell": 64, "chunk": 100, "gather": 20}), (700, 200, {"bits": 192, "cell": 16})])
def test_recall_order_and_scores(spark, n, dims, kw):
    x = points(n, dims, n + dims)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    docs = table(spark, rows)
    got = hs.search(docs, docs.where(F.col("vec_id") % 25 == 0), **kw)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    want = brute(rows, range(0, n, 25), 5)
    found = {}
    for r in got.collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == set(want)
    hits = 0
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    for q, some in found.items():
        some.sort()
        assert [r for r, *_ in some] == [1, 2, 3, 4, 5]
        assert [(-round(s, 12), i) for _, i, s in some] == sorted((-round(s, 12), i) for _, i, s in some)
        assert all(abs(s - u[q] @ u[i]) < 1e-12 and i != q for _, i, s in some)
        hits += len({i for i, _ in want[q]} & {i for _, i, _ in some})
    assert hits >= 0.95 * 5 * len(want)


@pytest.mark.parametrize("width", [0, 3, 16])
def test_every_code_within_the_radius_is_retrieved_once(spark, width):
    rng = np.random.default_rng(width)
    x = points(300, 32, 3)
    nodes = spark.createDataFrame([(i, -i, v.tolist()) for i, v in enumerate(x)], "h1 long, h2 long, embedding array<float>")
    model = hs.Model.learn([v.tolist() for v in x[:200]], 128, 1, 10, 2.0)
    codes = model.encode(hs.unit(x.astype(np.float64)))
    asked = nodes.selectExpr("h1 AS q1", "h2 AS q2", "embedding").where("h1 % 10 = 0")
    opened = asked.mapInArrow(hs._open(model, 5, 1), hs._ddl(hs.OPENED))
    radii = {q: int(rng.integers(0, 70)) for q in range(0, 300, 10)}
    given = opened.join(spark.createDataFrame(list(radii.items()), "q1 long, radius int"), "q1")
    stored = nodes.mapInArrow(hs._code(model), hs._ddl(hs.CODED))
    got = hs._retrieve(stored, given, 10_000, 128, width, 40).collect()
    apart = hs.hamming(codes, codes)
    want = {(q, v) for q, r in radii.items() for v in np.flatnonzero(apart[q] <= r).tolist()}
    assert len(got) == len(want) and {(r["q1"], r["h1"]) for r in got} == want
    u = hs.unit(x.astype(np.float64))
    assert all(r["low"] <= u[r["q1"]] @ u[r["h1"]] <= r["high"] for r in got)


def test_allowances_cover_every_split_of_the_radius():
    rng = np.random.default_rng(0)
    for _ in range(2000):
        m, r = int(rng.integers(1, 9)), int(rng.integers(0, 60))
        split = rng.multinomial(r, np.ones(m) / m)
        assert (split <= hs.allowances(np.array([r]), m)[0]).any()


def test_codes_of_learned_rotations_lose_less():
    x = hs.unit(points(2000, 32, 8, 0.0).astype(np.float64) * np.geomspace(1, 20, 32))
    model = hs.Model.learn(x.tolist(), 64, 1, 20, 2.0)
    plain = np.concatenate(hs._random_parts(32, 64, 1), axis=1)
    loss = lambda turn: ((np.sign(x @ turn) / np.sqrt(32) - x @ turn) ** 2).sum()
    assert loss(model.rotations[32]) < 0.9 * loss(plain)
    assert np.allclose(model.rotations[32][:, :32].T @ model.rotations[32][:, :32], np.eye(32))


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (50, [1.0, 0.0]), (100, [0.0, 0.0]), (150, None), (200, []), (250, [nan, 1.0]), (300, [inf, 1.0]), (350, [None, 1.0]), (400, [3e38, 3e38]), (450, [1e-45, 0.0]), (None, [1.0, 0.0]), (7, [-1.0, 0.0]), (8, [1.0, 2.0, 3.0]), (500, [1.0, 2.0, 3.0]), (9, [0.0, -0.0]), (550, [1.0]), (50, [0.0, 2.0])]
    docs = table(spark, rows)
    got = hs.search(docs, docs.where("vec_id % 50 = 0")).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], round(r["score"], 6)))
    half = round(0.5**0.5, 6)
    assert sorted(by[0]) == [(1, 50, 1.0), (2, 450, 1.0), (3, 400, half), (4, 50, 0.0), (5, 7, -1.0)]
    assert sorted(by[450]) == [(1, 0, 1.0), (2, 50, 1.0), (3, 400, half), (4, 50, 0.0), (5, 7, -1.0)]
    assert len(by[50]) == 10 and by[500] == [(1, 8, 1.0)] and 550 not in by
    assert set(by) == {0, 50, 400, 450, 500}
    assert hs.search(docs.limit(0), docs.limit(0)).count() == 0
    assert hs.search(docs, docs.limit(0)).count() == 0 and hs.search(docs.limit(0), docs).count() == 0


def test_doubles_and_equal_vectors(spark):
    rows = [(i, [1e300, 1e300 * (i % 3)]) for i in range(400)]
    docs = table(spark, rows, "vec_id long, embedding array<double>")
    got = hs.search(docs, docs.where("vec_id % 50 = 0")).collect()
    for q in range(0, 400, 50):
        assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == [i for i in range(400) if i % 3 == q % 3 and i != q][:5]


def test_query_takes_every_fiftieth(spark):
    got = op12_hash_search(spark, "/root/testdata/sf0.001").collect()
    n = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where("vec_id % 50 = 0").count()
    assert len(got) == 5 * n
