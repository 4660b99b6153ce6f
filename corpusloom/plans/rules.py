"""Rule queries: conditions over line items and orders, labels, references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import logic
from corpusloom.operators import rules as ops
from corpusloom.plans.registry import query, table


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag", "l_tax")


def status(op: str, expected: list[str], actual, unit: str | None = None, actual_unit=None):
    lit = lambda v: F.lit(v).cast("string")
    return logic.evaluate_condition(F.lit("field"), F.lit(op), F.array(*[F.lit(e) for e in expected]), lit(unit), actual, lit(actual_unit) if not hasattr(actual_unit, "isNull") else actual_unit, F.lit(True))


CONDITIONS = {"quantity": ("이상", ["25"]), "discount": ("between_inclusive", ["0.02", "0.06"]), "flag": ("in", ["A", "r"])}


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity >= 25 THEN 'SATISFIED' ELSE 'NOT_SATISFIED' END AS quantity, CASE WHEN l_discount BETWEEN 0.02 AND 0.06 THEN 'SATISFIED' ELSE 'NOT_SATISFIED' END AS discount,
CASE WHEN l_returnflag IN ('A', 'R') THEN 'SATISFIED' ELSE 'NOT_SATISFIED' END AS flag, CASE WHEN l_quantity * 1000 > 30000 THEN 'SATISFIED' ELSE 'NOT_SATISFIED' END AS power, 'UNKNOWN' AS other_dimension FROM lineitem""")
def condition_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir)
    numeric = logic.literal_condition
    return rows.select(
        "l_orderkey", "l_linenumber", numeric(*CONDITIONS["quantity"], F.col("l_quantity")).alias("quantity"), numeric(*CONDITIONS["discount"], F.col("l_discount")).alias("discount"), status(*CONDITIONS["flag"], F.col("l_returnflag")).alias("flag"),
        numeric("gt", ["30,000"], F.col("l_quantity"), "W", "kW").alias("power"), numeric("gt", ["1"], F.col("l_quantity"), "dwt", "gt").alias("other_dimension"),
    )


@query("SELECT l_linenumber, CASE WHEN l_quantity >= 25 THEN 'SATISFIED' ELSE 'NOT_SATISFIED' END AS status, count(*) AS n FROM lineitem GROUP BY ALL")
def condition_table_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same evaluator where operator, value and unit are columns of a table of conditions, joined by line number."""
    rows = lines(spark, sf_dir).withColumn("operator", F.lit("gte")).withColumn("expected", F.array(F.lit("25")))
    found = logic.evaluate_condition(F.lit("quantity"), F.col("operator"), F.col("expected"), F.lit(None).cast("string"), F.col("l_quantity").cast("string"), F.lit(None).cast("string"), F.lit(True))
    return rows.groupBy("l_linenumber", found.alias("status")).agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_quantity >= 25 AS q, l_discount BETWEEN 0.02 AND 0.06 AS d, l_returnflag = 'N' AS f FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN NOT q OR NOT d THEN 'NOT_SATISFIED' WHEN f THEN 'UNKNOWN' ELSE 'SATISFIED' END AS all_of, CASE WHEN q OR d THEN 'SATISFIED' WHEN f THEN 'UNKNOWN' ELSE 'NOT_SATISFIED' END AS any_of FROM s""")
def tri_state_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir)
    third = F.when(F.col("l_returnflag") == "N", logic.INVALID)
    statuses = F.array_compact(F.array(status(*CONDITIONS["quantity"], F.col("l_quantity").cast("string")), status(*CONDITIONS["discount"], F.col("l_discount").cast("string")), third))
    known = rows.select("l_orderkey", "l_linenumber", statuses.alias("s"))  # a step of its own: evaluated once, read often
    return known.select("l_orderkey", "l_linenumber", logic.combine(F.col("s"), F.lit("AND")).alias("all_of"), logic.combine(F.col("s"), F.lit("any")).alias("any_of"))


@query("""WITH s AS (SELECT CASE WHEN l_returnflag = 'R' THEN 'EXCEPTION_APPLIES' WHEN l_quantity < 5 THEN 'NOT_APPLICABLE' WHEN l_tax = 0 THEN 'INSUFFICIENT_INFORMATION' WHEN l_discount > 0.05 THEN 'NON_COMPLIANT' ELSE 'COMPLIANT' END AS label FROM lineitem) SELECT label, count(*) AS n FROM s GROUP BY label""")
def rule_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda ok: F.when(ok, logic.SATISFIED).otherwise(logic.NOT_SATISFIED)
    requirement = F.when(F.col("l_tax") == 0, logic.UNKNOWN).otherwise(pick(F.col("l_discount") <= 0.05))
    label = logic.rule_label(pick(F.col("l_quantity") >= 5), requirement, pick(F.col("l_returnflag") == "R"))
    return lines(spark, sf_dir).groupBy(label.alias("label")).agg(F.count("*").alias("n"))


@query("""WITH l AS (SELECT doc_id, CASE quality WHEN 1 THEN 'COMPLIANT' ELSE 'NON_COMPLIANT' END AS g, CASE doc_id % 3 WHEN 0 THEN 'COMPLIANT' WHEN 1 THEN 'NON_COMPLIANT' ELSE 'NOT_APPLICABLE' END AS v, CASE doc_id % 4 WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN 'COMPLIANT' ELSE 'NON_COMPLIANT' END AS p FROM labels)
SELECT doc_id, CASE WHEN p = 'UNKNOWN' THEN 'PROGRAM_UNEVALUABLE' WHEN g = v AND v = p THEN 'THREE_WAY_MATCH' WHEN v = p THEN 'GENERATOR_DISAGREES' WHEN g = p THEN 'VERIFIER_DISAGREES' WHEN g = v THEN 'PROGRAM_DISAGREES' ELSE 'ALL_DISAGREE' END AS agreement,
CASE WHEN p = 'UNKNOWN' THEN 'program_unevaluable_keep_existing' WHEN g = v AND v = p THEN 'accepted' WHEN v = p THEN 'generator_label_mismatch' WHEN v <> p THEN 'program_verifier_label_mismatch' END AS reason FROM l""")
def label_three_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.when(F.col("quality") == 1, "COMPLIANT").otherwise("NON_COMPLIANT")
    pick = lambda m, names: F.get(F.array(*[F.lit(n) for n in names]), (F.col("doc_id") % m).cast("int"))
    v, p = pick(3, ["COMPLIANT", "NON_COMPLIANT", "NOT_APPLICABLE"]), pick(4, ["UNKNOWN", "COMPLIANT", "NON_COMPLIANT", "NON_COMPLIANT"])
    rows = table(spark, sf_dir, "labels").select("doc_id", v.alias("v"), p.alias("p"), logic.compare_labels(g, v, p).alias("c"))
    decided = logic.training_decision(F.lit("ACCEPT"), F.col("c.agreement"), F.col("v"), F.col("p"), "strict")
    return rows.select("doc_id", F.col("c.agreement").alias("agreement"), decided["reason"].alias("reason"))


@query("""WITH t AS (SELECT p_partkey - p_partkey % 2 * CAST(p_size > 25 AS INT) AS ref, p_partkey FROM part), u AS (SELECT ref, min(p_partkey) AS target FROM t GROUP BY ref HAVING count(*) = 1)
SELECT l_orderkey, l_linenumber, target FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem) JOIN u ON l_partkey = ref""")
def unique_ref_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as references with exactly one target: large odd parts go by the number of the part before them, so
    some numbers have two targets and some none."""
    refs = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("ref")).distinct().withColumn("rid", F.struct("l_orderkey", "l_linenumber", "ref"))
    number = F.col("p_partkey") - F.col("p_partkey") % 2 * (F.col("p_size") > 25).cast("int")
    targets = table(spark, sf_dir, "part").select(number.alias("ref"), F.col("p_partkey").alias("target"))
    return ops.unique_references(refs, targets, ["ref"], "rid", "target").select("l_orderkey", "l_linenumber", "target")


@query("""SELECT o_orderkey, o_custkey, lag(o_orderkey) OVER w AS previous_id, lead(o_orderkey) OVER w AS next_id FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def neighbour_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.struct("o_orderdate", "o_orderkey").alias("at"))
    return ops.neighbours(rows, "o_custkey", "at", "o_orderkey").drop("at")


@query("""WITH r AS (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS i, greatest(count(*) OVER (PARTITION BY s_nationkey) // 2, 1) AS step FROM supplier)
SELECT s_nationkey, s_suppkey FROM r WHERE i % step = 0 AND i // step < 2""")
def stride_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.stride_sample(table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey"), "s_nationkey", "s_suppkey", 2)


@query("""SELECT o_orderpriority AS track, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY o_orderpriority""")
def track_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.pivot_counts(table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "track"), "track", "o_orderstatus", ["F", "O", "P"])


@query("""SELECT l_orderkey, l_linenumber, array_to_string(list_filter([CASE WHEN l_quantity > 45 THEN 'bulk' END, CASE WHEN l_discount > 0.08 THEN 'discount' END, CASE WHEN l_tax = 0 THEN 'untaxed' END], lambda x: x IS NOT NULL), ',') AS reasons FROM lineitem WHERE l_quantity > 45 OR l_discount > 0.08 OR l_tax = 0""")
def expert_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    reasons = ops.review_reasons({"bulk": F.col("l_quantity") > 45, "discount": F.col("l_discount") > 0.08, "untaxed": F.col("l_tax") == 0})
    return lines(spark, sf_dir).select("l_orderkey", "l_linenumber", reasons.alias("r")).where(F.size("r") > 0).select("l_orderkey", "l_linenumber", F.array_join("r", ",").alias("reasons"))


@query("""SELECT c.c_custkey, o.o_orderkey AS latest FROM customer c LEFT JOIN (SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) o ON c.c_custkey = o.o_custkey""")
def last_wins_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.struct("o_orderdate", "o_orderkey").alias("at"))
    last = ops.last_wins(orders, ["o_custkey"], "at").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("latest"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(last, "c_custkey", "left")
