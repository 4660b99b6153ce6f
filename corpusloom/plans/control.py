"""Control-plane queries over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import control as ops
from corpusloom.plans.registry import query, table


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


@query("""WITH n AS (SELECT max(ts) AS now FROM events) SELECT user_id AS tenant, round(sum(value), 4) AS spend, count(*) AS n FROM events, n WHERE ts >= date_trunc('month', now) AND ts <= now GROUP BY user_id""")
def ledger_mtd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month-to-date spend as of the last event; one value is looked up first."""
    rows = events(spark, sf_dir)
    now = rows.agg(F.max("ts").alias("now")).first()["now"]
    ledger = rows.select(F.col("user_id").alias("tenant"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("cost"))
    return ops.month_to_date(ledger, F.lit(now).cast("timestamp")).withColumn("spend", F.round("spend", 4))


@query()
def sliding_rpm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.sliding_limit(events(spark, sf_dir).withColumnRenamed("user_id", "tenant"), limit=2, seconds=3600)


@query("""SELECT user_id, event_type, event_id, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""")
def latest_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user and type, as an upserted registry."""
    return ops.latest(events(spark, sf_dir), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", F.round("value", 6).alias("value"))


@query("""SELECT user_id AS trace_id, count(*) AS spans, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000 AS duration_ms, bool_or(event_type = 'error') AS error, arg_min(event_id, event_id) FILTER (event_type = 'purchase') AS tokens FROM events GROUP BY user_id""")
def trace_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    spans = events(spark, sf_dir).select(F.col("user_id").alias("trace_id"), at.alias("start_us"), at.alias("end_us"), (F.col("event_type") == "error").alias("error"), F.when(F.col("event_type") == "purchase", F.col("event_id")).alias("tokens"), F.col("event_id").alias("ord"))
    return ops.trace_summary(spans)


@query("SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def audit_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.tail(events(spark, sf_dir), [F.desc("ts"), F.desc("event_id")], 50).select("event_id", "user_id", "event_type")


@query("SELECT event_id, event_type FROM events ORDER BY value DESC NULLS LAST, event_id LIMIT 20 OFFSET 40")
def audit_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.page(events(spark, sf_dir).select("event_id", "event_type", "value"), [F.desc_nulls_last("value"), F.col("event_id")], 40, 20).select("event_id", "event_type")


@query("""WITH p AS (SELECT * FROM (VALUES ('click', 0.5, 1.0), ('view', 0.25, 2.0), ('purchase', 2.0, 3.0)) t(model, price_in, price_out))
SELECT e.event_type AS model, count(*) AS n, round(CAST(sum((e.event_id % 100) * coalesce(p.price_in, 0) + (e.event_id % 7) * coalesce(p.price_out, 0)) AS DOUBLE), 2) AS cost FROM events e LEFT JOIN p ON e.event_type = p.model GROUP BY e.event_type""")
def usage_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = spark.sql("SELECT * FROM VALUES ('click', 0.5D, 1.0D), ('view', 0.25D, 2.0D), ('purchase', 2.0D, 3.0D) AS t(model, price_in, price_out)")
    usage = events(spark, sf_dir).select(F.col("event_type").alias("model"), (F.col("event_id") % 100).alias("n_in"), (F.col("event_id") % 7).alias("n_out"))
    return ops.price_usage(usage, prices).groupBy("model").agg(F.count("*").alias("n"), F.round(F.sum("cost"), 2).alias("cost"))


@query("""WITH u AS (SELECT user_id, count(*) AS n, sum(value) AS v FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN user_id % 5 = 0 THEN 'model_not_allowed' WHEN n > 110 THEN 'rate_limited' WHEN coalesce(v, 0) >= 5000 THEN 'budget_exceeded' ELSE 'allowed' END AS decision FROM u""")
def policy_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    usage = events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("v"))
    return usage.select("user_id", ops.authorize(F.col("user_id") % 5 != 0, F.col("n") <= 110, F.coalesce("v", F.lit(0.0)) < 5000).alias("decision"))


@query("SELECT count(*) AS n, round(avg(CASE WHEN event_type IN ('click', 'view') THEN 1.0 ELSE 0.0 END), 4) AS hit_rate FROM events")
def cache_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.hit_rate(events(spark, sf_dir), F.col("event_type").isin("click", "view"))


@query("""WITH k AS (SELECT doc_id, sha256(text) AS sha, CAST(doc_id % 4 + 1 AS INT) AS version FROM documents WHERE doc_id % 3 <> 0), i AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN sha256(text || '!') ELSE sha256(text) END AS sha FROM documents)
SELECT i.doc_id, i.sha, CASE WHEN k.sha IS NULL THEN 1 WHEN k.sha <> i.sha THEN k.version + 1 ELSE k.version END AS version, CASE WHEN k.sha IS NULL THEN 'new' WHEN k.sha <> i.sha THEN 'changed' ELSE 'unchanged' END AS status FROM i LEFT JOIN k USING (doc_id)""")
def document_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    known = docs.where("doc_id % 3 <> 0").select("doc_id", F.sha2("text", 256).alias("sha"), (F.col("doc_id") % 4 + 1).cast("int").alias("version"))
    incoming = docs.select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(F.sha2("text", 256)).alias("sha"))
    return ops.register_documents(known, incoming)


@query("""WITH e AS (SELECT user_id AS release_id, event_id AS ord, CASE event_type WHEN 'view' THEN 'request' WHEN 'purchase' THEN 'approve' WHEN 'error' THEN 'reject' ELSE 'require' END AS kind, 'u' || event_id % 3 AS actor FROM events)
SELECT release_id, arg_max(kind, ord) AS state, arg_min(actor, ord) FILTER (kind = 'request') AS requester, arg_max(actor, ord) FILTER (kind = 'approve') AS approver,
coalesce(arg_min(actor, ord) FILTER (kind = 'request') <> arg_max(actor, ord) FILTER (kind = 'approve'), true) AS separate FROM e GROUP BY release_id""")
def release_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "request").when(F.col("event_type") == "purchase", "approve").when(F.col("event_type") == "error", "reject").otherwise("require")
    return ops.release_state(events(spark, sf_dir).select(F.col("user_id").alias("release_id"), F.col("event_id").alias("ord"), kind.alias("kind"), F.concat(F.lit("u"), F.col("event_id") % 3).alias("actor")))


@query("""WITH t AS (SELECT s_nationkey AS model, s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'canary' ELSE 'stable' END AS rollout FROM supplier), c AS (SELECT *, count(*) OVER (PARTITION BY model, rollout) AS n, count(*) OVER (PARTITION BY model) AS a FROM t)
SELECT model, s_suppkey, rollout, round(CASE WHEN n = a THEN 1.0 WHEN rollout = 'canary' THEN 0.2 ELSE 0.8 END / n, 6) AS weight FROM c""")
def canary_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("model"), "s_suppkey", F.when(F.col("s_suppkey") % 4 == 0, "canary").otherwise("stable").alias("rollout"))
    return ops.canary_weights(entries, 0.2)


@query("""SELECT coalesce(a.s_nationkey, b.n_nationkey) AS key, coalesce(a.total, 0) AS total FROM (SELECT s_nationkey, count(*) AS total FROM supplier WHERE s_acctbal > 0 GROUP BY s_nationkey) a FULL JOIN (SELECT n_nationkey FROM nation) b ON a.s_nationkey = b.n_nationkey""")
def live_over_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = table(spark, sf_dir, "supplier").where("s_acctbal > 0").groupBy(F.col("s_nationkey").alias("key")).agg(F.count("*").alias("total"))
    stored = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.lit(0).cast("long").alias("total"))
    return ops.prefer_live(live, stored, "key")
