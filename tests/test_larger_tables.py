"""Queries on tables that hold what only larger ones do, against DuckDB."""

import time

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__
from corpusloom.operators import alignment, references, retrieval
from corpusloom.operators.retrieval import hashing_embedding
from tests.test_queries import rows


def same_as_sql(spark, folder, name, **tables):
    """The query's rows over the tables, once they agree with its SQL's."""
    con = duckdb.connect()
    for table, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got = __spark_entry__.queries()[name](spark, str(folder))
    want = con.execute(__spark_entry__.oracle_sql()[name])
    names = [c[0] for c in want.description]
    found = got.collect()
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, [tuple(r) for r in found]) == rows(names, want.fetchall())
    return found


def vectors(spark, ids, dims=8, labels=3, seed=1):
    x = np.random.default_rng(seed).normal(size=(len(ids), dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    held = pd.DataFrame({"vec_id": ids, "embedding": [v.tolist() for v in x], "label": [int(i) % labels for i in ids]})
    return spark.createDataFrame(held, "vec_id long, embedding array<float>, label int")


def test_editions_of_sections_whose_number_reads_as_a_year(spark, tmp_path):
    found = same_as_sql(spark, tmp_path, "edition_dedup", embeddings=vectors(spark, [0, 1, *range(3790, 3830), *range(39_990, 40_010)], labels=2))
    assert len({r["section"] for r in found}) == 31


def test_staged_hits_keep_sections_whose_number_reads_as_a_year(spark, tmp_path):
    found = same_as_sql(spark, tmp_path, "retrieve_staged", embeddings=vectors(spark, [*range(3800, 3860)], dims=3))
    assert len(found) == 8


def test_hashing_embedding_has_unit_length(spark):
    got = spark.createDataFrame([("a b b",), ("Von.*** Keitkeitkeit.&&&",), (None,)], "text string").select(hashing_embedding(F.col("text")).alias("v")).collect()
    assert [len(r["v"]) for r in got] == [256] * 3
    assert [round(sum(x * x for x in r["v"]), 9) for r in got] == [1, 0, 0]


def test_documents_whose_hashed_tokens_cancel_out(spark, tmp_path):
    texts = ["Von.*** Keitkeitkeit.&&&", "a b c", None, "", "***", "\u212aelvin \u0130stanbul", "Von von 가나"]
    found = same_as_sql(spark, tmp_path, "hashing_embed", documents=spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in found) == [1, 2, 3, 4, 5, 6]


def by_expression(store, queries, k, least=None):
    """What search should give, by the expression for each pair."""
    scored = store.crossJoin(queries).select("query_id", "vec_id", retrieval.dot(F.col("embedding"), F.col("vector")).alias("score"))
    scored = scored if least is None else scored.where(F.col("score") >= least)
    if k is None:
        return sorted(map(repr, scored.collect()))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return sorted(map(repr, scored.withColumn("rank", rank).where(F.col("rank") <= k).collect()))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_search_takes_matrix_products_for_all_usual_vectors(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK_QUERIES", 4)
    monkeypatch.setattr(retrieval, "BLOCK_ROWS", 16)
    store = vectors(spark, [*range(200)], dims=5).unionByName(vectors(spark, [*range(1000, 1200)], dims=5))  # equal vectors
    odd = [(2000, None), (2001, [float("nan")] + [0.5] * 4), (2002, [0.5, 0.5]), (2003, [None] + [0.5] * 4), (2004, [float("inf")] + [0.0] * 4), (2005, [0.0] * 5), (2006, []), (None, [0.5] * 5)]
    store = store.drop("label").unionByName(spark.createDataFrame(odd, "vec_id long, embedding array<float>"))
    queries = store.where("vec_id % 19 = 0 OR vec_id > 1999").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    for k, least, most in ((3, None, 20_000), (500, None, 9), (7, 0.5, 20_000), (None, 0.7, 20_000)):
        got = retrieval.search(store, queries, k, least, most_queries=most)
        assert sorted(map(repr, got.collect())) == by_expression(store, queries, k, least)
    named = store.withColumn("vec_id", F.concat(F.lit("v"), "vec_id"))
    assert sorted(map(repr, retrieval.search(named, queries, 3).collect())) == by_expression(named, queries, 3)


def test_nearest_vectors_by_matrix_products(spark, tmp_path):
    same_as_sql(spark, tmp_path, "vector_topk", embeddings=vectors(spark, [*range(500)]))
    assert "MapInArrow" in plan_of(__spark_entry__.queries()["vector_topk"](spark, str(tmp_path)))


def test_recall_by_matrix_products(spark, tmp_path):
    same_as_sql(spark, tmp_path, "knn_recall_mrr", embeddings=vectors(spark, [*range(500)]))
    assert "MapInArrow" in plan_of(__spark_entry__.queries()["knn_recall_mrr"](spark, str(tmp_path)))


def test_threshold_by_matrix_products(spark, tmp_path):
    same_as_sql(spark, tmp_path, "vector_threshold", embeddings=vectors(spark, [*range(500)]))
    assert "MapInArrow" in plan_of(__spark_entry__.queries()["vector_threshold"](spark, str(tmp_path)))


def test_contexts_leave_documents_where_they_are(spark, tmp_path):
    vectors(spark, [*range(500)]).write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(i, f"text {i} " * 99) for i in range(500)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = __spark_entry__.queries()["context_trim"](spark, str(tmp_path))
    plan = plan_of(got)
    assert "MapInArrow" in plan and "SortMergeJoin" not in plan
    nearest = __spark_entry__.queries()["vector_topk"](spark, str(tmp_path)).where("rank <= 2").groupBy("query_id").agg(F.collect_set("vec_id").alias("v")).collect()
    told = {r["query_id"]: r["context"] for r in got.collect()}
    assert len(told) == 10 and all(f"doc {v}\n" in told[r["query_id"]] for r in nearest for v in [*r["v"], r["query_id"]])


def test_terms_asked_for_by_many_articles_of_a_large_chapter(spark):
    n, asks = 40_000, "2편 3장에서 규정하는 압력용기{}에 따른다"
    rows = [(f"a{i}", "1편_가", "rule", "9", str(i), "제목", asks.format(i % 4)) for i in range(n)]
    rows += [(f"t{i}", "2편_나", "rule", "3", str(i), {0: "압력용기0", 1: "압력용기1", 2: "압력용기1"}.get(i, "제목"), "압력용기2 압력용기2" if i == 9 else "압력용기2 압력용기3") for i in range(n)]
    articles = spark.createDataFrame(rows, "chunk_id string, source_file string, document_type string, chapter_no string, article_no string, article_title string, content string")
    start = time.monotonic()
    got = references.cross_document_references(articles).groupBy("target", "form").agg(F.count("*").alias("n")).collect()
    assert sorted(map(tuple, got)) == [("t0", "2 term", n // 4), ("t9", "2 term", n // 4)]
    assert time.monotonic() - start < 60  # each pair of a reference and a text would be 1.6 billion


def test_drift_counts_empty_documents_as_its_sql_does(spark, tmp_path):
    texts = ["", None, "  ", "one", "two words", "drei " * 40, "vier " * 300]
    docs = [(i, texts[i % 7] if i % 3 else "one two", ("en", "de", "fr")[i % 3]) for i in range(420)] + [(900 + i, ("", "ab 1")[i % 2], "es") for i in range(160)]
    same_as_sql(spark, tmp_path, "drift_verdict", documents=spark.createDataFrame(docs, "doc_id long, text string, lang string"))


def test_clusters_of_zero_vectors_and_nan_as_their_sql_says(spark, tmp_path):
    usual = vectors(spark, [*range(60)], dims=4, labels=4).where("vec_id NOT IN (8, 12, 13, 17)")
    odd = [(8, [0.0] * 4, 0), (12, [0.0] * 4, 1), (13, [0.0] * 4, 1), (17, [float("nan"), 1.0, 0.0, 0.0], 1)]
    found = same_as_sql(spark, tmp_path, "vector_clusters", embeddings=usual.unionByName(spark.createDataFrame(odd, "vec_id long, embedding array<float>, label int")))
    assert len(found) > 50


def test_units_of_a_long_document_are_placed_in_one_pass_over_its_runs():
    words = [f"w{i * 7919 % 100_003}" for i in range(60_000)]
    assert alignment._runs("a bc d e fg h") == [("a bc d e fg", 0), ("bc d e fg h", 2)] and list(alignment._runs("")) == []
    units = [" ".join(words[i : i + 30]) for i in range(0, len(words), 30)]
    assert alignment.anchors(units, " ".join(units)) == [(u, units_at + at) for u, units_at in enumerate(np.cumsum([0, *(len(u) + 1 for u in units[:-1])]).tolist()) for _, at in alignment._runs(units[u])]
    assert alignment.rising([(0, 5), (1, 1), (2, 2), (3, 9), (4, 3)]) == [(1, 1), (2, 2), (4, 3)]
    assert isinstance(alignment._runs("a b c d e"), list)  # slices of the text, not words put together again


def test_documents_are_placed_in_batches_not_a_group_each(spark, tmp_path):
    docs = [(i, "\n".join(f"line {i} {k} of some words" for k in range(i % 9))) for i in range(60)] + [(None, "no key\nat all")]
    same_as_sql(spark, tmp_path, "unit_blocks", documents=spark.createDataFrame(docs, "doc_id long, text string"))
    plan = plan_of(__spark_entry__.queries()["unit_blocks"](spark, str(tmp_path)))
    assert "MapInPandas" in plan and "CoGroups" not in plan
