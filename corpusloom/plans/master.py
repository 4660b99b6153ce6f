"""Queries over the master set, its stand-ins made of orders (rules), line items (excerpts, cases) and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import answers, logic, verification
from corpusloom.operators import master as ops
from corpusloom.plans.registry import query, table

KINDS = ("compliant", "subtle_nc", "clear_nc", "insufficient", "boundary_c", "exception_nm", "other")


def pick(names, n):
    return F.element_at(F.array(*[F.lit(x) for x in names]), (n + 1).cast("int"))


def sql_pick(names, n: str) -> str:
    return f"[{', '.join(repr(x) for x in names)}][{n} + 1]"


def excerpts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Orders as excerpts of their customer's rule; customers, orders and their lines as the other rows."""
    orders, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    text = lambda c: c.cast("string")
    out = {"excerpts": orders.select(text(k).alias("id"), text(F.col("o_custkey") + F.when(k % 10 == 0, 10_000_000).otherwise(0)).alias("rule_id"), pick(KINDS, k % 7).alias("kind"), F.when(k % 2 == 0, "compliant").otherwise("non_compliant").alias("target_label"))}
    rules = table(spark, sf_dir, "customer").select(text(F.col("c_custkey")).alias("id"), F.lit(1).alias("ord"), F.col("c_name").alias("doc_title"))
    out["rules"] = rules.unionByName(rules.where("id % 5 = 0").withColumn("ord", F.lit(2)).withColumn("doc_title", F.concat("doc_title", F.lit(" new"))))
    out["profiles"] = orders.where("o_orderkey % 3 <> 0").select(text(k).alias("id"), F.lit(1).alias("ord"), F.col("o_orderpriority").alias("text"))
    out["annotations"] = orders.where("o_orderkey % 4 <> 0").select(text(k).alias("id"), F.lit(1).alias("ord"), F.col("o_orderstatus").alias("annotation"))
    out["verdicts"] = orders.where("o_orderkey % 5 <> 0").select(text(k).alias("id"), F.lit(1).alias("ord"), F.when(k % 3 == 0, "compliant").otherwise("non_compliant").alias("derived_label"))
    return out


@query(f"""WITH e AS (SELECT *, {sql_pick(KINDS, 'o_orderkey % 7')} AS kind FROM orders) SELECT CAST(o_orderkey AS VARCHAR) AS sample_id, CASE WHEN kind IN ('compliant', 'subtle_nc', 'clear_nc', 'other') THEN 'compliance_judgment' WHEN kind = 'insufficient' THEN 'insufficient_information' WHEN kind = 'boundary_c' THEN 'condition_verification' ELSE 'exception_judgment' END AS task_type,
c_name || CASE WHEN c_custkey % 5 = 0 THEN ' new' ELSE '' END AS doc_title, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS profile, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderstatus END AS annotation, CASE WHEN o_orderkey % 5 <> 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'compliant' ELSE 'non_compliant' END END AS verdict
FROM e JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 10 <> 0""")
def judgment_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ops.judgment_samples(**excerpts(spark, sf_dir))
    return rows.select("sample_id", "task_type", F.col("rule.doc_title").alias("doc_title"), F.col("profile.text").alias("profile"), F.col("annotation.annotation").alias("annotation"), F.col("verdict.derived_label").alias("verdict"))


@query("""WITH r AS (SELECT count(*) FILTER (c_custkey % 5 = 0) AS dup FROM customer), e AS (SELECT o_orderkey AS k, c_custkey IS NOT NULL AND o_orderkey % 10 <> 0 AS ruled FROM orders LEFT JOIN customer ON o_custkey = c_custkey)
SELECT count(*) FILTER (NOT ruled) AS orphan_excerpt_no_rule, count(*) FILTER (ruled AND k % 3 = 0) AS orphan_excerpt_no_profile, count(*) FILTER (ruled AND k % 4 = 0) AS excerpt_no_annotation, count(*) FILTER (ruled AND k % 5 = 0) AS excerpt_no_verdict, any_value(dup) AS duplicate_rule_cards FROM e CROSS JOIN r""")
def judgment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.judgment_counts(**excerpts(spark, sf_dir))


AGREEMENTS = ("THREE_WAY_MATCH", "PROGRAM_DISAGREES", "VERIFIER_DISAGREES", "SEMANTIC_AXIS_MISMATCH", "VERIFIER_ABSTENTION_CONFLICT")
CASE_KINDS = ("numeric_boundary", "exception_full", "compliance_behavior", "plain")
MODES = ("mandatory", "prohibition", "permission")


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("case_id"), F.col("o_custkey").alias("rule_id"), pick(CASE_KINDS, k % 4).alias("kind"), pick(MODES, k % 3).alias("modality"), F.when(k % 7 == 0, F.lit(None).cast("string")).otherwise(pick(AGREEMENTS, k % 5)).alias("said"),
        F.when(k % 2 == 0, "APPLICABLE").otherwise("UNKNOWN").alias("program_label"), F.when(k % 6 == 0, "NOT_APPLICABLE").otherwise("APPLICABLE").alias("verifier_label"), F.when(k % 9 == 0, "COMPLIANT").otherwise("NOT_ASSESSED").alias("compliance"), k,
    )


CASES = f"c AS (SELECT o_orderkey AS k, o_custkey, {sql_pick(CASE_KINDS, 'o_orderkey % 4')} AS kind, {sql_pick(MODES, 'o_orderkey % 3')} AS modality, CASE WHEN o_orderkey % 7 <> 0 THEN {sql_pick(AGREEMENTS, 'o_orderkey % 5')} END AS said, o_orderkey % 2 = 0 AS evaluable, o_orderkey % 6 <> 0 AS same, o_orderkey % 9 = 0 AS assessed FROM orders)"


@query(f"WITH {CASES} SELECT agreement, count(*) AS n FROM (SELECT coalesce(said, 'VERIFIER_PENDING') AS agreement FROM c WHERE o_custkey % 4 <> 0 AND o_custkey IN (SELECT c_custkey FROM customer)) GROUP BY agreement")
def case_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cases(spark, sf_dir)
    rules = table(spark, sf_dir, "customer").where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("id"))
    verified = rows.where("said IS NOT NULL").select("case_id", F.col("said").alias("agreement"), "verifier_label")
    return ops.case_samples(rows.select("case_id", "rule_id", "program_label"), rules, verified).groupBy("agreement").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT c_nationkey AS chunk_id, min(c_custkey) AS rid FROM customer WHERE c_nationkey % 3 <> 0 GROUP BY 1), q AS (SELECT s_suppkey, s_nationkey FROM supplier)
SELECT s_suppkey AS question_id, CAST(coalesce(rid, s_nationkey) AS VARCHAR) AS rule_id, rid IS NOT NULL AS joined, CASE WHEN s_suppkey % 2 = 0 THEN 'own ' || s_suppkey WHEN rid IS NOT NULL THEN 'path ' || rid END AS section_path, s_suppkey % 5 = 0 OR s_suppkey % 7 = 0 AS needs_review FROM q LEFT JOIN r ON s_nationkey = chunk_id""")
def suite_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as questions on their nation; the first customer of a nation is its rule."""
    k = F.col("s_suppkey")
    questions = table(spark, sf_dir, "supplier").select(k.alias("question_id"), F.col("s_nationkey").cast("string").alias("chunk_id"), F.when(k % 2 == 0, F.concat(F.lit("own "), k)).otherwise("").alias("section_path"), (k % 5 == 0).alias("needs_review"))
    rules = table(spark, sf_dir, "customer").where("c_nationkey % 3 <> 0").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_custkey").alias("ord"), F.col("c_nationkey").cast("string").alias("chunk_id"), F.concat(F.lit("path "), "c_custkey").alias("section_path"))
    verdicts = table(spark, sf_dir, "supplier").where("s_suppkey % 7 = 0 OR s_suppkey % 11 = 0").select(k.alias("question_id"), F.when(k % 7 == 0, "REJECT").otherwise("ACCEPT").alias("verdict"))
    return ops.suite_samples(questions, rules, verdicts).drop("suite_verdict")


GROUPED = """g AS (SELECT doc_id, lang, source, CASE WHEN doc_id % 3 = 0 THEN 'unknown-publisher' ELSE 'kr' END || '|' || replace(source, ' ', '') || '|unknown-edition|rule-' || doc_id // 4 AS key FROM documents),
s AS (SELECT *, 'crg_' || substr(sha256(key), 1, 16) AS group_id FROM g), t AS (SELECT *, CASE WHEN b < 0.8 THEN 'train' WHEN b < 0.9 THEN 'validation' ELSE 'test' END AS split FROM (SELECT *, ('0x' || substr(sha256('7:' || group_id), 1, 8))::BIGINT / 4294967295.0 AS b FROM s))"""


@query(f"WITH {GROUPED}, d AS (SELECT group_id, unnest(['lang', 'source', 'split', 'total']) AS dimension, unnest([lang, source, split, '']) AS value FROM t) SELECT dimension, value, count(*) AS n, count(DISTINCT group_id) AS n_groups FROM d GROUP BY dimension, value")
def build_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as samples of rules of four, split by canonical group."""
    no = F.lit(None).cast("string")
    uid = F.concat(F.lit("KR__file__Rule > "), F.floor(F.col("doc_id") / 4))
    group = ops.canonical_group(F.when(F.col("doc_id") % 3 == 0, "").otherwise("KR "), F.col("source"), no, uid, no, F.lit("unused"), no, F.col("doc_id").cast("string"))
    rows = table(spark, sf_dir, "documents").select("lang", "source", group["id"].alias("group_id")).withColumn("split", ops.split_of_group(F.col("group_id"), 7, 0.8, 0.1))
    return ops.build_report(rows, ["lang", "source"])


@query(f"""WITH {CASES}, r AS (SELECT c_custkey AS k FROM customer), k AS (SELECT k, CASE k % 5 WHEN 0 THEN 'MISSING_STRUCTURE' WHEN 1 THEN 'PROGRAM_EVALUABLE' WHEN 2 THEN 'PROGRAM_PARTIALLY_EVALUABLE' WHEN 3 THEN 'QUALITATIVE_ONLY' ELSE 'INVALID_RULE_CARD' END AS cls FROM r)
SELECT 'class' AS counter, cls AS key, count(*) AS n FROM k GROUP BY cls UNION ALL SELECT 'operator', op, count(*) FROM (SELECT unnest(CASE k % 5 WHEN 1 THEN ['gte', '이하'] WHEN 2 THEN ['gte', 'about'] WHEN 3 THEN ['?'] ELSE [] END) AS op FROM r) GROUP BY op UNION ALL SELECT 'unit', 'mm', count(*) FROM r WHERE k % 5 = 1
UNION ALL SELECT 'agreement', said, count(*) FROM c WHERE said IS NOT NULL GROUP BY said UNION ALL SELECT 'task agreement', kind || ' ' || said, count(*) FROM c WHERE said IS NOT NULL GROUP BY kind, said""")
def evaluator_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    cond = lambda r, o, v, u=None: F.struct(F.lit(r).alias("requirement"), F.lit(o).alias("operator"), F.lit(v).alias("value"), F.lit(u).cast("string").alias("unit"))
    none = F.array().cast("array<struct<requirement:string,operator:string,value:string,unit:string>>")
    made = F.when(k % 5 == 0, none).when(k % 5 == 1, F.array(cond("R1", "gte", "5", "mm"), cond("R1", "이하", "9", ""))).when(k % 5 == 2, F.array(cond("R1", "gte", "5"), cond("R1", "about", "5"))).when(k % 5 == 3, F.array(cond("R1", "", "")))
    rules = table(spark, sf_dir, "customer").select(made.alias("conditions"))
    samples = cases(spark, sf_dir).select(F.col("kind").alias("task_type"), F.col("said").alias("agreement"))
    return ops.evaluator_report(rules, samples)


@query(f"""WITH {CASES} SELECT modality, count(*) AS n, count(said) AS judged, round(avg(CASE WHEN said IS NOT NULL THEN CASE WHEN said = 'THREE_WAY_MATCH' THEN 1.0 ELSE 0 END END), 4) AS match_rate, count(*) FILTER (assessed) AS assessable FROM c GROUP BY modality""")
def modality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.modality_report(cases(spark, sf_dir).withColumn("agreement", F.coalesce("said", F.lit("VERIFIER_PENDING"))))


@query(f"""WITH {CASES}, m AS (SELECT round(avg(CASE WHEN said IS NOT NULL AND evaluable THEN CASE WHEN same THEN 1.0 ELSE 0 END END), 4) AS a, round(avg(CASE WHEN said IS NOT NULL AND evaluable AND modality = 'prohibition' THEN CASE WHEN same THEN 1.0 ELSE 0 END END), 4) AS b,
round(avg(CASE WHEN said IS NOT NULL AND evaluable AND kind = 'exception_full' THEN CASE WHEN same THEN 1.0 ELSE 0 END END), 4) AS c, round(avg(CASE WHEN said = 'SEMANTIC_AXIS_MISMATCH' THEN 1.0 ELSE 0 END), 4) AS d FROM c), x AS (SELECT unnest(['program_verifier_match_rate', 'prohibition_match_rate', 'exception_match_rate', 'semantic_axis_mismatch_rate', 'canonical_group_leakage', 'strict_derivable_rate']) AS criterion, unnest([a, b, c, d, 0.0, NULL]) AS value, unnest([a >= 0.95, b >= 0.95, c >= 0.9, d <= 0.01, true, false]) AS met FROM m)
SELECT criterion, value, coalesce(met, false) AS met FROM x""")
def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cases(spark, sf_dir).withColumn("agreement", F.col("said")).withColumn("group_id", F.col("rule_id")).withColumn("split", F.col("rule_id") % 3)
    wanted = ("program_verifier_match_rate", "prohibition_match_rate", "exception_match_rate", "semantic_axis_mismatch_rate", "canonical_group_leakage", "strict_derivable_rate")
    return ops.readiness(ops.readiness_metrics(rows), {k: ops.CRITERIA[k] for k in wanted})


@query("""WITH c AS (SELECT p_partkey AS k, p_size AS v, CASE p_partkey % 4 WHEN 0 THEN 'gte' WHEN 1 THEN 'gt' WHEN 2 THEN 'lte' ELSE 'lt' END AS op FROM part WHERE p_partkey % 9 <> 0), b AS (SELECT *, unnest(['below', 'at', 'above']) AS variant, unnest([-1, 0, 1]) AS d FROM c)
SELECT k AS rule_id, variant, CAST(v + d AS DOUBLE) AS value, CASE WHEN CASE op WHEN 'gte' THEN v + d >= v WHEN 'gt' THEN v + d > v WHEN 'lte' THEN v + d <= v ELSE v + d < v END THEN 'APPLICABLE' ELSE 'NOT_APPLICABLE' END AS label, CAST(k % 7 + CASE WHEN k % 2 = 0 THEN 0 ELSE 1 END AS DOUBLE) AS other FROM b""")
def boundary_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as requirements of two conditions: on the size, and on a number that must be reached or passed; those whose
    second condition can't be met by a whole number have no cases."""
    k = F.col("p_partkey")
    part = table(spark, sf_dir, "part")
    first = part.select(k.alias("rule_id"), F.lit("R1").alias("requirement_id"), F.lit(1).alias("n"), F.lit("size").alias("field"), pick(("gte", "gt", "lte", "lt"), k % 4).alias("operator"), F.col("p_size").cast("double").alias("value"))
    second = part.select(k.alias("rule_id"), F.lit("R1").alias("requirement_id"), F.lit(2).alias("n"), F.lit("weight").alias("field"), F.when(k % 9 == 0, "ne").when(k % 2 == 0, "eq").otherwise("gt").alias("operator"), (k % 7).cast("double").alias("value"))
    made = ops.boundary_cases(first.unionByName(second)).where("field = 'size'")
    return made.select("rule_id", "variant", "value", "label", F.get("facts", F.lit(0))["value"].alias("other"))


@query(f"""WITH {CASES}, x AS (SELECT k, kind, coalesce(said, 'PROGRAM_DISAGREES') AS before, CASE WHEN k % 8 <> 0 THEN {sql_pick(AGREEMENTS, 'k % 3')} END AS after, k % 11 = 0 AS removed FROM c WHERE said IS DISTINCT FROM 'THREE_WAY_MATCH')
SELECT resolution, count(*) AS n FROM (SELECT CASE WHEN removed THEN CASE WHEN kind = 'exception_full' THEN 'RULE_CARD_REJECTED' ELSE 'CASE_REJECTED' END WHEN after IS NULL THEN 'NOT_REVERIFIED' WHEN after = 'THREE_WAY_MATCH' THEN CASE kind WHEN 'exception_full' THEN 'RESOLVED_EXCEPTION_STRUCTURE' WHEN 'compliance_behavior' THEN 'RESOLVED_FACT_REALIZATION' WHEN 'numeric_boundary' THEN 'RESOLVED_NUMERIC_REASONING' ELSE 'RESOLVED_BY_INTENT_REWRITE' END
WHEN after = 'PROGRAM_DISAGREES' THEN 'PROGRAM_EVALUATOR_ERROR' ELSE 'EXPERT_REVIEW_REQUIRED' END AS resolution FROM x) GROUP BY resolution""")
def reprocess_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cases(spark, sf_dir)
    before = rows.select("case_id", F.col("kind").alias("case_kind"), F.coalesce("said", F.lit("PROGRAM_DISAGREES")).alias("agreement"))
    after = rows.where("case_id % 8 <> 0").select("case_id", pick(AGREEMENTS, F.col("case_id") % 3).alias("agreement"))
    return ops.reprocess_report(before, after, rows.where("case_id % 11 <> 0")).groupBy("resolution").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT event_id, user_id AS source, CASE WHEN event_id % 2 = 0 THEN 'tuned' ELSE 'base' END AS tag, event_id % 5 - 1 AS score FROM events)
SELECT source, max_by(event_id, event_id) FILTER (tag = 'tuned') AS tuned_gen, max_by(event_id, event_id) FILTER (tag = 'base') AS base_gen, max_by(score, event_id) FILTER (tag = 'tuned' AND score >= 0) AS tuned_score, max_by(score, event_id) FILTER (tag = 'base' AND score >= 0) AS base_score FROM e GROUP BY source""")
def evaluation_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as cases, their events as answers and scores of two models."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("source"), F.when(F.col("event_id") % 2 == 0, "tuned").otherwise("base").alias("tag"), F.col("event_id").alias("ord"), F.col("event_id").alias("gen"), (F.col("event_id") % 5 - 1).alias("score"))
    return ops.evaluation_pivot(rows.select("source").distinct(), rows, rows)


@query("""WITH m AS (SELECT c_custkey // 3 AS cluster, c_custkey AS id, c_nationkey % 2 = 0 AS own FROM customer), g AS (SELECT cluster, count(*) AS n, min(id) FILTER (own) AS own_id, min(id) FILTER (NOT own) AS other_id FROM m GROUP BY cluster)
SELECT cluster, own_id, other_id FROM g WHERE n BETWEEN 2 AND 6 AND own_id IS NOT NULL AND other_id IS NOT NULL AND own_id % 10 <> 0 AND other_id % 10 <> 0""")
def cross_publisher_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in clusters of three; every tenth stands twice among the articles and so for none."""
    k = F.col("c_custkey")
    members = table(spark, sf_dir, "customer").select(F.floor(k / 3).alias("cluster"), k.alias("ord"), F.when(F.col("c_nationkey") % 2 == 0, "KR").otherwise("DNV").alias("soc"), k.alias("chunk_id"))
    articles = members.select("chunk_id")
    return ops.cross_publisher_pairs(members, articles.unionByName(articles.where("chunk_id % 10 = 0")))


HEX = "CAST('0x' || substr(md5('42:{}:' || p_partkey), 1, 8) AS BIGINT)".format


@query(f"""WITH p AS (SELECT p_partkey AS id, p_brand AS b, CASE WHEN p_size % 10 <> 0 THEN p_size END AS c, {HEX('at')} AS pos, {HEX('own')} AS own, {HEX('out')} AS far FROM part),
g AS (SELECT *, CASE WHEN c IS NULL THEN '1' ELSE '0' END || ':' || b || ':' || coalesce(CAST(c AS VARCHAR), CAST(id AS VARCHAR)) AS g FROM p),
r AS (SELECT *, row_number() OVER (ORDER BY g, pos, id) - 1 AS place, count(*) OVER (PARTITION BY g) AS size, count(*) OVER () AS total FROM g), s AS (SELECT *, min(place) OVER (PARTITION BY g) AS start FROM r),
o AS (SELECT id, start + (place - start + 1 + own % (size - 1)) % size AS goal, 1 AS rank FROM s WHERE size > 1
      UNION ALL SELECT id, (start + size + (far + j * ((total - size) // (3 - CAST(size > 1 AS INT)))) % (total - size)) % total, j + 1 + CAST(size > 1 AS INT) FROM s, range(3) t(j) WHERE j < 3 - CAST(size > 1 AS INT))
SELECT o.id AS chunk_id, s.id AS distractor, CAST(o.rank AS INTEGER) AS rank FROM o JOIN s ON s.place = o.goal""")
def rule_distractors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three distractors for each part, the first of its size and brand; every tenth size counts as no chapter."""
    rules = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("chunk_id"), F.col("p_brand").alias("publisher"), F.when(F.col("p_size") % 10 != 0, F.col("p_size")).alias("chapter"))
    return ops.distractors(rules, 3, rows_a_task=500)


@query("""WITH h AS (SELECT l_orderkey AS query_id, l_partkey AS parent_id, min(l_linenumber) AS rank FROM lineitem GROUP BY ALL) SELECT query_id, parent_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, parent_id) AS rank FROM h WHERE parent_id % 3 <> 0 AND parent_id % 5 <> 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank, parent_id) <= 2""")
def hard_distractors(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("parent_id")).agg(F.min("l_linenumber").alias("rank"))
    keys = hits.select("query_id", "parent_id")
    return ops.hard_distractors(hits, keys.where("parent_id % 3 = 0"), keys.where("parent_id % 5 = 0"), 2)


@query("""WITH p AS (SELECT o_orderkey AS k, o_orderkey % 20 <> 0 AS inc FROM orders), c AS (SELECT count(*) AS n, count(*) FILTER (NOT inc) AS m FROM p), f AS (SELECT n, m, CAST(round_even(n * 0.15, 0) AS BIGINT) - m AS flips, (n - m) // (CAST(round_even(n * 0.15, 0) AS BIGINT) - m) AS step FROM c),
r AS (SELECT k, inc, row_number() OVER (PARTITION BY inc ORDER BY k) - 1 AS i FROM p) SELECT k AS ord, CASE WHEN inc AND i % step = 0 AND i // step < flips THEN false ELSE inc END AS include_golden, CASE WHEN inc AND i % step = 0 AND i // step < flips THEN 'ng_forced' END AS tag FROM r CROSS JOIN f""")
def even_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.even_flips(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ord"), (F.col("o_orderkey") % 20 != 0).alias("include_golden")))


@query("""SELECT event_id AS run_id, last_value(CASE WHEN event_type <> 'error' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS incumbent FROM events""")
def incumbent_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "events").select(F.col("event_id").alias("run_id"), F.col("user_id").alias("name"), F.when(F.col("event_type") == "error", "failed").otherwise("succeeded").alias("status"), F.col("ts").alias("finished"), "value")
    return ops.incumbent(runs, "value").select("run_id", "incumbent")


@query("""WITH p AS (SELECT p_partkey AS k, p_brand, p_size * 60 AS tokens, p_partkey % 6 AS t FROM part), r AS (SELECT * FROM p WHERE tokens >= 150 AND t NOT IN (0, 1, 2) AND k % 4 <> 0)
SELECT p_brand AS source_file, k FROM r QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY tokens <= 1500 DESC, CASE WHEN tokens <= 1500 THEN -tokens ELSE tokens END, k) = 1""")
def requirement_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as articles of their brand: those that state requirements, and of these the richest of each document."""
    k = F.col("p_partkey")
    title = pick(("General", "용어의 정의", "2009", "Hull strength", "재료", "Welding"), k % 6)
    parents = table(spark, sf_dir, "part").select(k, F.col("p_brand").alias("source_file"), F.lit("DNV").alias("publisher"), F.lit("parent").alias("chunk_level"), (F.col("p_size") * 60).alias("content_tokens"), title.alias("article_title"), F.lit("rule").alias("document_type"), F.concat(F.lpad(k.cast("string"), 9, "0"), F.when(k % 4 == 0, "_INTRO").otherwise("_A")).alias("chunk_id"))
    return ops.one_per_document(ops.requirement_articles(parents, 150)).select("source_file", F.col("p_partkey").alias("k"))


SHOWN = ("적용", "비적용", "의무 발생", "판단 불가")
LABELS = ("APPLICABLE", "NOT_APPLICABLE", "OBLIGATION_TRIGGERED", "INSUFFICIENT_INFORMATION")


@query(f"""WITH d AS (SELECT doc_id, doc_id % 4 AS t, doc_id % 6 AS form FROM documents) SELECT doc_id, CASE WHEN form = 5 THEN NULL ELSE {sql_pick(LABELS, 't')} END AS label,
CAST(CASE WHEN form = 5 THEN 0.0 WHEN form = 4 THEN CASE WHEN t = 3 THEN 0.6 ELSE 0.8 END WHEN form = 3 THEN CASE WHEN t = 3 THEN 0.6 ELSE 0.8 END WHEN form = 2 THEN 0.8 WHEN t = 3 THEN CASE WHEN form = 1 THEN 1.0 ELSE 0.8 END ELSE 1.0 END AS DOUBLE) AS score FROM d""")
def answer_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Built answers read again: whole (0, 1 with what is missing), without evidence (2), with a section twice (3), out of
    order (4), and free prose (5)."""
    form, shown = F.col("doc_id") % 6, pick(SHOWN, F.col("doc_id") % 4)
    built = answers.build_answer({"evidence": F.when(form != 2, "조 301 「인용」"), "condition_review": answers.bullets(F.array(F.lit(" 두께 9 mm "), F.lit(" "))), "decision": shown, "missing_information": F.when(form == 1, "도면")})
    text = F.when(form == 5, "자유로운 서술").when(form == 4, F.concat(F.lit("판단: "), shown, F.lit("\n근거: 조 301"))).when(form == 3, F.concat(built, F.lit("\n\n근거:\n다시"))).otherwise(built)
    text = F.when((form == 2) & (F.col("doc_id") % 4 == 3), F.concat(built, F.lit(""))).otherwise(text)
    return table(spark, sf_dir, "documents").select("doc_id", answers.answer_label(text).alias("label"), F.round(answers.format_score(text), 4).alias("score"))


@query(f"""WITH d AS (SELECT doc_id, doc_id % 4 AS t, doc_id % 3 AS g FROM documents) SELECT doc_id, CAST(CASE WHEN g = 2 THEN 0.0 WHEN (g = 0 AND t = 0) OR (g = 1 AND t = 2) THEN 1.0 ELSE 0.0 END AS DOUBLE) AS by_label, CAST(CASE WHEN t IN (2, 3) THEN 1.0 ELSE 0.25 END AS DOUBLE) AS by_intent,
CAST(CASE WHEN doc_id % 2 = 0 THEN 0.5 ELSE 0.0 END AS DOUBLE) AS coverage FROM d""")
def answer_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, text = F.col("doc_id"), F.concat(F.lit("근거:\n선체 두께\n\n판단:\n"), pick(SHOWN, F.col("doc_id") % 4))
    gold = pick(("APPLICABLE", "OBLIGATION_TRIGGERED", "UNKNOWN"), d % 3)
    named = F.array(F.struct(F.when(d % 2 == 0, "선체_두께").otherwise("폭").alias("field"), F.lit("12").alias("value")), F.struct(F.lit("applicability_asserted").alias("field"), F.lit("true").alias("value")), F.struct(F.lit("높이").alias("field"), F.lit("30").alias("value")))
    return table(spark, sf_dir, "documents").select("doc_id", answers.label_reward(text, gold, F.lit(True)).alias("by_label"), answers.intent_reward(text, F.lit("obligation_triggered")).alias("by_intent"), answers.condition_coverage(text, named).alias("coverage"))


APPS = ("APPLICABLE", "NOT_APPLICABLE", "EXCEPTION_APPLIES", "INSUFFICIENT_INFORMATION", "ODD")
AXES = ("mandatory", "prohibition", "permission", "exemption", "definition")


@query(f"""WITH o AS (SELECT o_orderkey AS k, {sql_pick(APPS, 'o_orderkey % 5')} AS app, {sql_pick(AXES, '(o_orderkey // 5) % 5')} AS m, CASE (o_orderkey // 25) % 3 WHEN 0 THEN true WHEN 1 THEN false END AS done FROM orders),
n AS (SELECT *, CASE WHEN app = 'ODD' THEN 'UNKNOWN' WHEN app = 'INSUFFICIENT_INFORMATION' THEN app WHEN m = 'exemption' THEN CASE WHEN app = 'EXCEPTION_APPLIES' THEN app ELSE 'EXCEPTION_NOT_APPLIES' END WHEN app = 'EXCEPTION_APPLIES' THEN app
WHEN m = 'mandatory' THEN CASE app WHEN 'APPLICABLE' THEN 'OBLIGATION_TRIGGERED' ELSE 'OBLIGATION_NOT_TRIGGERED' END WHEN m = 'prohibition' THEN CASE app WHEN 'APPLICABLE' THEN 'PROHIBITED' ELSE 'NOT_PROHIBITED' END WHEN m = 'permission' THEN CASE app WHEN 'APPLICABLE' THEN 'PERMITTED' ELSE 'NOT_PERMITTED' END ELSE app END AS normative FROM o),
c AS (SELECT *, CASE WHEN done IS NULL THEN 'NOT_ASSESSED' WHEN normative = 'PROHIBITED' THEN CASE WHEN done THEN 'NON_COMPLIANT' ELSE 'COMPLIANT' END WHEN normative = 'OBLIGATION_TRIGGERED' THEN CASE WHEN done THEN 'COMPLIANT' ELSE 'NON_COMPLIANT' END ELSE 'NOT_ASSESSED' END AS compliance FROM n)
SELECT k AS o_orderkey, normative, compliance, CASE m WHEN 'definition' THEN 'NOT_ASSESSED' ELSE normative END AS primary_label FROM c""")
def axis_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    app, mode = pick(APPS, k % 5), pick(AXES, F.floor(k / 5) % 5)
    done = F.when(F.floor(k / 25) % 3 == 0, True).when(F.floor(k / 25) % 3 == 1, False)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", app.alias("app"), mode.alias("mode"), done.alias("done")).withColumn("normative", logic.normative_label(F.col("app"), F.col("mode")))
    rows = rows.withColumn("compliance", logic.compliance_label(F.col("normative"), F.col("mode"), F.col("done")))
    primary = logic.primary_label(logic.default_intent(F.col("mode")), F.col("app"), F.col("normative"), F.col("compliance"))
    return rows.select("o_orderkey", "normative", "compliance", primary.alias("primary_label"))


@query("""WITH v AS (SELECT doc_id, quality = 1 AS same, toxic = 0 AS fine, doc_id % 3 <> 0 AS styled, doc_id % 10 = 0 AS odd FROM labels) SELECT doc_id, CASE WHEN odd OR NOT same OR NOT fine THEN 'REJECT' WHEN NOT styled THEN 'ACCEPT_WITH_EDIT' ELSE 'ACCEPT' END AS verdict, CASE WHEN odd OR NOT same THEN 'HIGH' WHEN NOT fine THEN 'MEDIUM' ELSE 'LOW' END AS priority,
CASE WHEN odd THEN 'invalid_verifier_output' WHEN NOT same AND NOT fine THEN 'label_mismatch:compliant->non_compliant,faithfulness_fail' WHEN NOT same THEN 'label_mismatch:compliant->non_compliant' WHEN NOT fine THEN 'faithfulness_fail' WHEN NOT styled THEN 'style_quality_fail' ELSE '' END AS reasons FROM v""")
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = lambda c: F.when(c, "PASS").otherwise("FAIL")
    checks = F.create_map(F.lit("faithfulness"), ok(F.col("toxic") == 0), F.lit("numeric_unit_consistency"), F.lit("PASS"), F.lit("logical_validity"), F.lit("PASS"), F.lit("style_quality"), ok(F.col("doc_id") % 3 != 0))
    derived = F.when(F.col("doc_id") % 10 == 0, "odd").when(F.col("quality") == 1, "compliant").otherwise("non_compliant")
    rows = table(spark, sf_dir, "labels").select("doc_id", logic.verdict(F.lit("compliant"), derived, checks).alias("v"))
    return rows.select("doc_id", "v.verdict", "v.priority", F.array_join("v.reasons", ",").alias("reasons"))


@query("""WITH l AS (SELECT l_orderkey AS k, l_linenumber AS n, min(l_quantity) AS q FROM lineitem GROUP BY ALL) SELECT k, n, CASE WHEN n % 3 = 0 THEN CAST(k % 50 + 1000 AS VARCHAR) ELSE '' END AS ungrounded, CASE WHEN n % 4 = 0 THEN 'Kd' ELSE '' END AS symbols, CASE WHEN n % 4 = 1 THEN 'Zb/Zs' ELSE '' END AS pairs, n % 2 = 0 AS quoted,
CASE WHEN n % 5 = 0 THEN 'both_conclusions' WHEN n % 5 = 1 THEN 'opposite_conclusion' ELSE '' END AS issues FROM l""")
def answer_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers made of line items against the article they should rest on."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n")).agg(F.min("l_quantity").alias("q"))
    article = F.lit("면재측 단면계수 Zb 는 1,250 cm3 이상, 부착판측 단면계수 Zs 는 97 % 이상으로 하여야 한다.")
    said = F.concat(F.lit("값은 1,250 이고 97 %"), F.when(F.col("n") % 3 == 0, F.concat(F.lit(" 및 "), (F.col("k") % 50 + 1000).cast("string"))).otherwise(""), F.when(F.col("n") % 4 == 0, " 계수 Kd 와 Zb, Zs").when(F.col("n") % 4 == 1, " 계수 Zb").otherwise(""))
    quote = F.when(F.col("n") % 2 == 0, "부착판측  단면계수 Zs 는").otherwise("없는 문장을 인용한 것")
    ends = F.when(F.col("n") % 5 == 0, "1항은 적용되지만 2항은 미적용").when(F.col("n") % 5 == 1, "이 조는 적용되지 않는다").otherwise("이 조는 적용된다. 미적용 사유가 아니다")
    pairs = F.array_join(F.transform(verification.symbol_pairs(article, said), lambda p: F.concat(p["a"], F.lit("/"), p["b"])), ",")
    return rows.select("k", "n", F.array_join(verification.ungrounded_numbers(said, article), ",").alias("ungrounded"), F.array_join(verification.foreign_symbols(said, article), ",").alias("symbols"), pairs.alias("pairs"), verification.quote_in(quote, article).alias("quoted"), F.array_join(verification.conclusion_issues(ends, F.lit("applicable")), ",").alias("issues"))


@query()
def edit_similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names against their manufacturer's brand and against each other in order."""
    from pyspark.sql import Window

    before = F.lag("p_name").over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey", verification.edit_similarity(F.col("p_name"), before).alias("similarity"))
