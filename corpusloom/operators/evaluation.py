"""Answer evaluation: case metrics, aggregates, leaderboards, gates, preference accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.metrics import case_metrics

METRICS = ("exact_match", "token_f1", "char_f1", "rouge_l")


def score_cases(cases: DataFrame, pred: str = "answer", ref: str = "expected") -> DataFrame:
    """cases with their metrics, each rounded to four places."""
    return cases.select("*", *case_metrics(F.col(pred), F.col(ref)))


def aggregate_cases(scored: DataFrame, by: list[str] | None = None, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Means of the rounded case metrics, rounded again, with the usual second names."""
    out = scored.groupBy(*(by or [])).agg(F.count("*").alias("n"), *[F.round(F.coalesce(F.avg(m), F.lit(0.0)), 4).alias(m) for m in metrics])
    if "token_f1" in metrics:
        out = out.withColumn("reference_f1", F.col("token_f1"))
    return out.withColumn("answer_match", F.col("exact_match")) if "exact_match" in metrics else out


def preference_metrics(pairs: DataFrame, chosen: Column, rejected: Column) -> DataFrame:
    """The share of pairs whose chosen side scores higher, and the mean margin."""
    return pairs.agg(F.count("*").alias("n"), F.round(F.avg((chosen > rejected).cast("double")), 4).alias("preference_accuracy"), F.round(F.avg(chosen - rejected), 4).alias("reward_margin"))


def main_score(metrics: Column, names: tuple[str, ...] = ("preference_accuracy", "answer_match", "reference_f1")) -> Column:
    """The first metric that is there and not zero."""
    return F.coalesce(*[F.nullif(F.try_element_at(metrics, F.lit(n)), F.lit(0.0)) for n in names], F.lit(0.0))


def leaderboard(results: DataFrame, score: Column, order: list[Column], by: str = "benchmark") -> DataFrame:
    """Ranks within each benchmark, best first."""
    return results.withColumn("score", score).withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), *order)))


def best_by_version(runs: DataFrame, fingerprint: str, score: Column, created: str) -> DataFrame:
    return runs.groupBy(fingerprint).agg(F.count("*").alias("runs"), F.max(score).alias("best_score"), F.max(created).alias("latest"))


def gate(metrics: DataFrame, minima: dict[str, float]) -> DataFrame:
    """metrics (name, value) against minima: one row, with the failed names; a missing one fails."""
    wanted = F.map_from_arrays(F.array(*[F.lit(k) for k in minima]), F.array(*[F.lit(float(v)) for v in minima.values()]))
    have = metrics.agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("have"))
    failed = F.array_sort(F.map_keys(F.map_filter(wanted, lambda k, v: F.coalesce(F.try_element_at("have", k) < v, F.lit(True)))))
    return have.select(failed.alias("failed")).withColumn("passed", F.size("failed") == 0)


def judge_summary(scores: DataFrame, tag: str = "tag", score: str = "score") -> DataFrame:
    """Count, mean and share of four or more of each tag; negative scores are failures of the judge."""
    return scores.where(F.col(score) >= 0).groupBy(tag).agg(F.count("*").alias("n"), F.round(F.avg(score), 2).alias("avg"), F.round(F.avg((F.col(score) >= 4).cast("double")), 3).alias("ratio"))
