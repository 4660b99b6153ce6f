"""Dataset queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import split_name, stable_bucket
from corpusloom.operators import datasets as ops
from corpusloom.plans.registry import query, table

DIALOGUES = """r AS (SELECT conv_id, list({'role': role, 'content': text} ORDER BY turn) AS messages FROM conversations WHERE role IN ('system', 'user', 'assistant') AND coalesce(text, '') <> '' GROUP BY conv_id
HAVING count(*) FILTER (role = 'user') > 0 AND count(*) FILTER (role = 'assistant') > 0)"""


@query(f"""WITH {DIALOGUES} SELECT conv_id, len(messages) AS n_messages, array_to_string(list_transform(messages, lambda m: m.role || ': ' || m.content), chr(10)) AS rendered FROM r""")
def sft_from_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ops.dialogue_rows(table(spark, sf_dir, "conversations"))
    return rows.select("conv_id", F.size("messages").alias("n_messages"), F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n").alias("rendered"))


@query(f"""WITH {DIALOGUES}, a AS (SELECT conv_id, list_filter(messages, lambda m: m.role = 'assistant')[-1].content AS answer FROM r)
SELECT conv_id, length(answer) AS n_chars FROM a WHERE length(answer) BETWEEN 40 AND 400""")
def sft_length_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ops.filter_answer_length(ops.dialogue_rows(table(spark, sf_dir, "conversations")), 40, 400)
    return rows.select("conv_id", F.length(ops.last_answer()).alias("n_chars"))


@query(f"""WITH {DIALOGUES}, b AS (SELECT conv_id, CAST(('0x' || substr(md5('42:' || conv_id), 1, 8)) AS BIGINT) / 4294967295.0 AS bucket FROM r)
SELECT conv_id, round(bucket, 8) AS bucket, CASE WHEN bucket < 0.1 THEN 'test' WHEN bucket < 0.2 THEN 'validation' ELSE 'train' END AS split FROM b""")
def split_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucket = stable_bucket(F.col("conv_id"))
    return ops.dialogue_rows(table(spark, sf_dir, "conversations")).select("conv_id", F.round(bucket, 8).alias("bucket"), split_name(bucket, 0.1, 0.1).alias("split"))


@query(f"""WITH {DIALOGUES}, b AS (SELECT CASE WHEN bucket < 0.1 THEN 'test' WHEN bucket < 0.2 THEN 'validation' ELSE 'train' END AS split FROM (SELECT CAST(('0x' || substr(md5('42:' || conv_id), 1, 8)) AS BIGINT) / 4294967295.0 AS bucket FROM r))
SELECT split, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM b GROUP BY split""")
def dataset_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ops.dialogue_rows(table(spark, sf_dir, "conversations")).withColumn("split", split_name(stable_bucket(F.col("conv_id")), 0.1, 0.1))
    return ops.manifest(rows)


@query("""WITH p AS (SELECT l.doc_id, d.lang, l.quality, d.text, row_number() OVER (PARTITION BY d.lang, l.quality ORDER BY l.doc_id) AS k FROM labels l JOIN documents d USING (doc_id))
SELECT g.lang, g.doc_id AS chosen_id, b.doc_id AS rejected_id, left(g.text, 40) AS chosen, left(b.text, 40) AS rejected FROM p g JOIN p b ON g.lang = b.lang AND g.k = b.k AND g.quality = 1 AND b.quality = 0
WHERE coalesce(g.text, '') <> '' AND coalesce(b.text, '') <> ''""")
def preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A good and a bad document of one language by rank, as preference rows."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    from pyspark.sql import Window

    ranked = docs.select("doc_id", "lang", "quality", "text", F.row_number().over(Window.partitionBy("lang", "quality").orderBy("doc_id")).alias("k"))
    good = ranked.where("quality = 1").select("lang", "k", F.col("doc_id").alias("chosen_id"), F.col("text").alias("chosen"))
    bad = ranked.where("quality = 0").select("lang", "k", F.col("doc_id").alias("rejected_id"), F.col("text").alias("rejected"))
    both = good.join(bad, ["lang", "k"]).where("coalesce(chosen, '') <> '' AND coalesce(rejected, '') <> ''")
    return both.select("lang", "chosen_id", "rejected_id", F.left("chosen", F.lit(40)).alias("chosen"), F.left("rejected", F.lit(40)).alias("rejected"))


@query("""WITH l AS (SELECT '{"doc_id":' || doc_id || ',"n_chars":' || n_chars || ',"source":"' || source || '"}' AS line FROM documents)
SELECT sha256(string_agg(line, chr(10) ORDER BY line) || chr(10)) AS fingerprint, count(*) AS n FROM l""")
def dataset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.fingerprint(table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source"))


@query("""WITH l AS (SELECT sha256('{"doc_id":' || doc_id || ',"n_chars":' || n_chars || '}') AS h FROM documents) SELECT count(DISTINCT h) AS lines, count(*) AS n FROM l""")
def fingerprint_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return rows.select(F.sha2(F.to_json(F.struct("doc_id", "n_chars")), 256).alias("h")).agg(F.count_distinct("h").alias("lines"), F.count("*").alias("n"))


@query("""WITH d AS (SELECT doc_id, lang, source, CAST(substr(source, 4) AS INT) % 3 AS split FROM documents),
k AS (SELECT 'source' AS key, 'fail' AS level, count(*) FILTER (n > 1) AS leaks FROM (SELECT count(DISTINCT split) AS n FROM d GROUP BY source)
UNION ALL SELECT 'lang', 'warn', count(*) FILTER (n > 1) FROM (SELECT count(DISTINCT split) AS n FROM d GROUP BY lang))
SELECT key, level, leaks, CASE WHEN leaks = 0 THEN 'pass' ELSE level END AS status FROM k""")
def split_leak_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", "lang", (F.substring("source", 4, 9).cast("int") % 3).alias("split"))
    return ops.split_leaks(docs, {"source": "fail", "lang": "warn"})


@query("""WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS k FROM documents),
lack AS (SELECT coalesce(sum(greatest(50 - n, 0)), 0) AS lack FROM (SELECT count(*) AS n FROM r GROUP BY source)),
s AS (SELECT *, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS g FROM r WHERE k > 50)
SELECT doc_id, source, CASE WHEN k <= 10 THEN 'validation' ELSE 'train' END AS split FROM r WHERE k <= 50
UNION ALL SELECT doc_id, source, 'backfill' FROM s, lack WHERE g <= lack""")
def track_quota_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return ops.quota_split(docs, "source", F.struct(F.md5(F.col("doc_id").cast("string")), F.col("doc_id")), 50, 10).select("doc_id", "source", "split")


@query("""WITH d AS (SELECT doc_id, lang, CASE WHEN CAST(('0x' || substr(md5('7:' || source), 1, 8)) AS BIGINT) / 4294967295.0 < 0.3 THEN 'validation' ELSE 'train' END AS split, source FROM documents)
SELECT split, lang, count(*) AS n, count(DISTINCT source) AS n_groups FROM d GROUP BY GROUPING SETS ((split, lang), (split), ())""")
def group_split_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits by group, so that no group is torn, counted at three levels in one pass."""
    rows = table(spark, sf_dir, "documents").select("lang", "source", split_name(stable_bucket(F.col("source"), "7"), 0.0, 0.3).alias("split"))
    rows.createOrReplaceTempView("_group_split")
    return spark.sql("SELECT split, lang, count(*) AS n, count(DISTINCT source) AS n_groups FROM _group_split GROUP BY GROUPING SETS ((split, lang), (split), ())")
