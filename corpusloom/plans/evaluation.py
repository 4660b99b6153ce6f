"""Evaluation queries over question and answer turns and over events as results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import metrics as fn
from corpusloom.operators import evaluation as ops
from corpusloom.plans.registry import query, table

PAIRS = """p AS (SELECT conv_id, turn, text AS answer, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS expected FROM conversations), c AS (SELECT * FROM p WHERE expected IS NOT NULL)"""
FORM = r"trim(regexp_replace(lower(coalesce({0}, '')), '[\s\pZ]+', ' ', 'g'))"


def f1(a: str, b: str) -> str:
    """Multiset F1 of two lists of units in table c, by counts."""
    return f"""u AS (SELECT conv_id, turn, {a} AS ua, {b} AS ub FROM c),
ca AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest(ua) AS w FROM u) GROUP BY ALL), cb AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest(ub) AS w FROM u) GROUP BY ALL),
o AS (SELECT conv_id, turn, sum(least(ca.n, cb.n)) AS common FROM ca JOIN cb USING (conv_id, turn, w) GROUP BY ALL)
SELECT u.conv_id, u.turn, round(CASE WHEN coalesce(o.common, 0) = 0 THEN 0.0 ELSE 2 * (o.common / len(ua)) * (o.common / len(ub)) / (o.common / len(ua) + o.common / len(ub)) END, 4) AS score FROM u LEFT JOIN o USING (conv_id, turn)"""


def tokens(column: str) -> str:
    form = FORM.format(column)
    words = f"list_filter(string_split({form}, ' '), lambda w: w <> '')"
    return f"CASE WHEN len({words}) = 1 AND length({form}) > 1 THEN string_split({form}, '') ELSE {words} END"


def chars(column: str) -> str:
    bare = rf"regexp_replace(lower(coalesce({column}, '')), '[\s\pZ]+', '', 'g')"
    return f"list_filter(string_split({bare}, ''), lambda w: w <> '')"


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn with the next as what was expected."""
    after = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("answer"), after.alias("expected")).where("expected IS NOT NULL")


@query(f"WITH {PAIRS}, {f1(tokens('answer'), tokens('expected'))}")
def token_f1_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_pairs(spark, sf_dir).select("conv_id", "turn", F.round(fn.token_f1(F.col("answer"), F.col("expected")), 4).alias("score"))


@query(f"WITH {PAIRS}, {f1(chars('answer'), chars('expected'))}")
def char_f1_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_pairs(spark, sf_dir).select("conv_id", "turn", F.round(fn.char_f1(F.col("answer"), F.col("expected")), 4).alias("score"))


@query(f"WITH b AS (SELECT a.item_id AS a, b.item_id AS b, {FORM.format('a.text')} AS x, {FORM.format("(' ' || b.text)")} AS y FROM benchmark a JOIN benchmark b ON a.item_id = b.item_id OR a.item_id + 1 = b.item_id) SELECT a, b, CAST(CASE WHEN x <> '' AND x = y THEN 1 ELSE 0 END AS DOUBLE) AS score FROM b")
def exact_match_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    other = items.select(F.col("item_id").alias("b"), F.concat(F.lit("  "), F.col("text")).alias("ref"), F.explode(F.array(F.col("item_id"), F.col("item_id") - 1)).alias("item_id"))
    return items.join(other, "item_id").select(F.col("item_id").alias("a"), "b", fn.exact_match(F.col("text"), F.col("ref")).alias("score"))


@query()
def rouge_l_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_pairs(spark, sf_dir).select("conv_id", "turn", F.round(fn.rouge_l(F.col("answer"), F.col("expected")), 4).alias("score"))


@query()
def reference_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.aggregate_cases(ops.score_cases(turn_pairs(spark, sf_dir)))


@query("""SELECT count(*) AS n, round(avg(CASE WHEN a.value > b.value THEN 1.0 ELSE 0.0 END), 4) AS preference_accuracy, round(avg(a.value - b.value), 4) AS reward_margin
FROM events a JOIN events b ON a.event_id + 1 = b.event_id WHERE a.value IS NOT NULL AND b.value IS NOT NULL""")
def preference_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "value")
    after = events.select((F.col("event_id") - 1).alias("event_id"), F.col("value").alias("next"))
    return ops.preference_metrics(events.join(after, "event_id").where("value IS NOT NULL AND next IS NOT NULL"), F.col("value"), F.col("next"))


@query("""WITH r AS (SELECT user_id % 5 AS benchmark, event_type AS model, round(avg(value), 6) AS score FROM events GROUP BY ALL)
SELECT benchmark, model, score, row_number() OVER (PARTITION BY benchmark ORDER BY score DESC, model) AS rank FROM r""")
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as models, ranked in each of five groups of users."""
    means = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 5).alias("benchmark"), F.col("event_type").alias("model")).agg(F.round(F.avg("value"), 6).alias("mean"))
    results = means.withColumn("metrics", F.create_map(F.lit("preference_accuracy"), F.lit(0.0), F.lit("answer_match"), F.col("mean")))
    return ops.leaderboard(results, ops.main_score(F.col("metrics")), [F.col("model")]).select("benchmark", "model", "score", "rank")


@query("""SELECT event_type AS tag, count(*) AS n, round(avg(event_id % 6), 2) AS avg, round(avg(CASE WHEN event_id % 6 >= 4 THEN 1.0 ELSE 0.0 END), 3) AS ratio FROM events GROUP BY event_type""")
def judge_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.judge_summary(table(spark, sf_dir, "events").select(F.col("event_type").alias("tag"), (F.col("event_id") % 6).alias("score")))


@query("""WITH m AS (SELECT event_type AS name, avg(value) AS value FROM events GROUP BY event_type), w AS (SELECT * FROM (VALUES ('click', 0.0), ('view', 1e9), ('absent', 0.5)) t(name, least))
SELECT list_sort(list(w.name) FILTER (m.value IS NULL OR m.value < w.least)) AS failed, count(*) FILTER (m.value IS NULL OR m.value < w.least) = 0 AS passed FROM w LEFT JOIN m USING (name)""")
def metric_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("name")).agg(F.avg("value").alias("value"))
    return ops.gate(means, {"click": 0.0, "view": 1e9, "absent": 0.5})


@query("""SELECT user_id % 20 AS fingerprint, count(*) AS runs, round(max(coalesce(nullif(value, 0), 0)), 4) AS best_score, max(event_id) AS latest FROM events GROUP BY 1""")
def best_by_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "events").withColumn("fingerprint", F.col("user_id") % 20)
    out = ops.best_by_version(runs, "fingerprint", F.coalesce(F.nullif("value", F.lit(0.0)), F.lit(0.0)), "event_id")
    return out.withColumn("best_score", F.round("best_score", 4))
