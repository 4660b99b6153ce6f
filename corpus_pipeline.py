"""The corpus pipeline: quality, near copies, benchmark passages, secrets, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the docs of the next. All but the last return the columns of documents.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import decontaminate, ngram_join, packing, quality_gam, secret_scan
from corpusloom.llm.storage import ensure_checkpoint_dir, remove
from corpusloom.workers import return_memory

#: Packing has no SQL form; the stages are tested against brute force.
ORACLE_SQL = None
#: Near copies of the pipeline: five-word shingles, Jaccard of 0.8 or more.
NEAR = {"words": 5, "num": 80, "den": 100}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; it learns from those of its input that have labels.

    Null and empty texts are scored like others; without labels all stay. Repeated rows share their fate.
    """
    model, score = quality_gam.train(docs, _table(spark, sf_dir, "labels")), f"score_{uuid.uuid4().hex}"
    return quality_gam.add_score(docs, model, score).where(F.col(score) >= 0.3).drop(score)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies."""
    return ngram_join.keep_one(docs, **NEAR)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found; null and empty texts hold none, and without items all stay."""
    return decontaminate.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced in the text and n_chars brought up to date."""
    out = secret_scan.redact_secrets(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of 2048-token sequences, as op7_packing gives them; a null text is its end id alone."""
    return packing.pack(docs)


def _lean(stage: Callable) -> Callable:
    """The stage, whose Python workers give freed memory back before the next stage uses them."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return_memory(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("quality_classifier", _lean(keep_quality)),
    ("ngram_jaccard_join", _lean(keep_one_of_near_copies)),
    ("benchmark_decontamination", _lean(drop_benchmark_passages)),
    ("secret_scans", _lean(redact_secrets)),
    ("packing", _lean(pack_documents)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; what a stage has read is removed
    once its own rows are written. An empty table gives no rows."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = _table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES[:-1]):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
