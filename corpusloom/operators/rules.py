"""Rule-corpus joins: unique references, first and last per key, trees of conditions, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.logic import combine, evaluate_condition


def unique_references(references: DataFrame, targets: DataFrame, on: list[str], ref_id: str, target_id: str) -> DataFrame:
    """References with their target where exactly one matches."""
    joined = references.join(targets, on)
    return joined.withColumn("_n", F.count("*").over(Window.partitionBy(ref_id))).where("_n = 1").drop("_n").select(*references.columns, target_id)


def last_wins(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))).where("_r = 1").drop("_r")


def first_wins(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(order))).where("_r = 1").drop("_r")


def neighbours(rows: DataFrame, key: str, order: str, id_column: str) -> DataFrame:
    """Each row with the ids before and after it under its key."""
    along = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("previous_id", F.lag(id_column).over(along)).withColumn("next_id", F.lead(id_column).over(along))


def cap_occurrences(rows: DataFrame, key: list[str], order: str, most: int) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(order))).where(F.col("_r") <= most).drop("_r")


def stride_sample(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """Every (count // n)-th row of a key, n at most."""
    along = Window.partitionBy(key).orderBy(order)
    counted = rows.withColumn("_i", F.row_number().over(along) - 1).withColumn("_step", F.greatest(F.floor(F.count("*").over(Window.partitionBy(key)) / n), F.lit(1)))
    return counted.where((F.col("_i") % F.col("_step") == 0) & (F.col("_i") / F.col("_step") < n)).drop("_i", "_step")


def named_references(mentions: DataFrame, documents: DataFrame, name: str, doc_name: str) -> DataFrame:
    """Mentions whose name stands in exactly one document's name. Names are a small list of fixed bound."""
    held = mentions.join(F.broadcast(documents), F.contains(F.col(doc_name), F.col(name)))
    return held.withColumn("_n", F.count("*").over(Window.partitionBy(*mentions.columns))).where("_n = 1").drop("_n")


def evaluate_conditions(conditions: DataFrame, facts: DataFrame) -> DataFrame:
    """conditions (rule_id, node_id, field, operator, expected, unit, evidence) with facts (case_id, field, value,
    unit): a status for every case and condition. A case without the field is UNKNOWN, not absent."""
    cases = facts.select("case_id").distinct()
    asked = cases.crossJoin(conditions)  # every case asks every condition: that is the result's size
    held = facts.select(F.col("case_id").alias("_case"), F.col("field").alias("_f"), F.col("value").alias("_value"), F.col("unit").alias("_unit"), F.lit(True).alias("_known"))
    both = asked.join(held, (F.col("case_id") == F.col("_case")) & (F.col("field") == F.col("_f")), "left")
    status = evaluate_condition(F.col("field"), F.col("operator"), F.col("expected"), F.col("unit"), F.col("_value"), F.col("_unit"), F.coalesce("_known", F.lit(False)), F.col("evidence"))
    return both.select("case_id", *conditions.columns, F.col("_value").alias("actual"), status.alias("status"))


def evaluate_trees(nodes: DataFrame, statuses: DataFrame, depth: int) -> DataFrame:
    """nodes (rule_id, node_id, parent_id, level, logic), leaves having statuses (case_id, rule_id, node_id, status):
    the status of each inner node, level by level from the deepest; at most `depth` levels."""
    known = statuses.select("case_id", "rule_id", "node_id", "status")
    for level in range(depth - 1, -1, -1):
        inner = nodes.where((F.col("level") == level) & F.col("logic").isNotNull()).select("rule_id", "node_id", "logic")
        children = nodes.select("rule_id", F.col("parent_id"), F.col("node_id").alias("child"))
        held = known.join(children, (known["rule_id"] == children["rule_id"]) & (known["node_id"] == children["child"])).select("case_id", known["rule_id"], F.col("parent_id").alias("node_id"), "status")
        found = held.groupBy("case_id", "rule_id", "node_id").agg(F.collect_list("status").alias("s")).join(inner, ["rule_id", "node_id"])
        known = known.unionByName(found.select("case_id", "rule_id", "node_id", combine(F.col("s"), F.col("logic")).alias("status")))
    return known


def pivot_counts(rows: DataFrame, key: str, status: str, names: list[str]) -> DataFrame:
    """Rows of each key in all and by status."""
    return rows.groupBy(key).agg(F.count("*").alias("total"), *[F.count_if(F.col(status) == n).alias(n) for n in names])


def review_reasons(checks: dict[str, Column]) -> Column:
    """Names of the checks that hold."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))
