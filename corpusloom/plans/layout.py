"""Layout and log queries. The supplied tables hold no figures, formulas or logs: rows are made of others by their keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import layout as ops
from corpusloom.plans.registry import query, table


@query("""WITH f AS (SELECT user_id AS doc_id, event_id AS seq, event_id // 500 AS page, event_id % 2 AS anchor, event_id % 3 = 0 AS numbered, CASE WHEN event_id % 3 = 0 THEN 'Figure ' || event_id ELSE 'panel ' || event_id % 2 END AS caption, 'p' || event_id AS path FROM events),
c AS (SELECT *, CASE WHEN page IS NOT DISTINCT FROM lag(page) OVER w AND anchor IS NOT DISTINCT FROM lag(anchor) OVER w THEN 0 ELSE 1 END AS fresh FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY seq)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY seq) AS island FROM c),
j AS (SELECT *, count(*) OVER g > 1 AND count(*) FILTER (numbered) OVER g = 1 AS joins, min(seq) OVER g AS first FROM i WINDOW g AS (PARTITION BY doc_id, island)),
k AS (SELECT *, CASE WHEN joins THEN first ELSE seq END AS place FROM j),
u AS (SELECT doc_id, place, caption, min(seq) AS low FROM k GROUP BY doc_id, place, caption), n AS (SELECT doc_id, place, string_agg(caption, ' ' ORDER BY low) AS caption FROM u GROUP BY doc_id, place)
SELECT k.doc_id, k.place AS seq, n.caption, CASE WHEN bool_or(joins) THEN max(path) FILTER (numbered) ELSE max(path) END AS img_path, CAST(count(*) AS INT) AS n_parts FROM k JOIN n ON k.doc_id = n.doc_id AND k.place = n.place GROUP BY k.doc_id, k.place, n.caption""")
def figure_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as pieces of figures."""
    e, none = F.col("event_id"), F.lit(None).cast("string")
    caption = F.when(e % 3 == 0, F.concat(F.lit("Figure "), e)).otherwise(F.concat(F.lit("panel "), e % 2))
    figures = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("doc_id"), e.alias("seq"), F.floor(e / 500).alias("page"), (e % 2).alias("anchor"), F.array(caption).alias("captions"),
        F.array().cast("array<string>").alias("footnotes"), F.concat(F.lit("p"), e).alias("img_path"), none.alias("content"), none.alias("sub_type"),
    )
    return ops.merge_figure_fragments(figures).select("doc_id", "seq", F.array_join("captions", " ").alias("caption"), "img_path", "n_parts")


@query("""WITH b AS (SELECT 'text' AS kind, l_orderkey AS doc_id, l_linenumber AS pos, l_linenumber AS seq FROM lineitem UNION ALL SELECT 'atom', l_orderkey, l_suppkey % 5, l_linenumber FROM lineitem)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos, kind, seq) - 1 AS ord, kind, seq FROM b""")
def interleaved_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as texts, and as atoms at positions among them."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("long").alias("seq"), (F.col("l_suppkey") % 5).cast("long").alias("at"), F.lit("").alias("content"))
    return ops.interleave(lines.withColumn("pos", F.col("seq")), lines.withColumn("pos", F.col("at"))).select("doc_id", "ord", "kind", "seq")


@query(r"""SELECT doc_id, 'of ' || source || ' $t_{' || doc_id % 7 || '.' || doc_id % 10 || '}=\alpha x$ and  $$ \text{as-built ' || lang || '}+10^{' || doc_id % 9 || '} $$.' AS text FROM documents""")
def tidy_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's source and language with formulas in spaced letters."""
    d = F.col("doc_id")
    parts = [F.lit("of "), F.col("source"), F.lit(" $ t _ {"), d % 7, F.lit(" . "), d % 10, F.lit("} = \\alpha  x $ and  $$\\text {a s - b u i l t  "), F.col("lang"), F.lit("} + 1 0 ^ {"), d % 9, F.lit("}$$.")]
    return table(spark, sf_dir, "documents").select("doc_id", ops.tidy_math(F.concat(*parts)).alias("text"))


@query("""WITH l AS (SELECT user_id AS run_id, event_id, (event_id % 1000) / 1000.0 AS loss, CASE WHEN event_id % 2 = 0 THEN (event_id % 40) / 4.0 END AS epoch FROM events WHERE event_id % 5 <> 0)
SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY event_id) AS step, CAST(loss AS DOUBLE) AS loss, CAST(epoch AS DOUBLE) AS epoch FROM l""")
def loss_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a line of a user's training log, each fifth without a loss."""
    e = F.col("event_id")
    epoch = F.when(e % 2 == 0, F.concat(F.lit(", 'epoch': "), e % 40 / 4)).otherwise("")
    line = F.when(e % 5 == 0, F.concat(F.lit("{'eval_loss': "), e, F.lit("}"))).otherwise(F.concat(F.lit(" {'loss': "), e % 1000 / 1000, F.lit(", 'lr': 1e-05"), epoch, F.lit("}")))
    return ops.loss_curve(table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), e.alias("ord"), line.alias("line")))


@query("""SELECT user_id AS run_id, 'trainable_params' AS key, CAST(max(event_id) AS VARCHAR) AS value FROM events GROUP BY user_id
UNION ALL SELECT user_id, 'host', CAST(arg_max(event_type, event_id) AS VARCHAR) FROM events GROUP BY user_id""")
def training_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a line of a user's training log that tells its parameters; the last one counts."""
    line = F.concat(F.lit("{'trainable_params': "), F.col("event_id"), F.lit(", 'host': '"), F.col("event_type"), F.lit("'}"))
    return ops.train_stats(table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("ord"), line.alias("line")))
