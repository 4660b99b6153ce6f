"""Settings of Python workers that operators share."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Blocks of 1 MB and more are given back once freed; otherwise a reused worker keeps what its largest batch took.
RETURNING = {"MALLOC_MMAP_THRESHOLD_": "1048576", "MALLOC_TRIM_THRESHOLD_": "1048576", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def return_memory(spark: SparkSession) -> None:
    """Python workers of functions made from now on give freed memory back to the system, unless the session says otherwise."""
    for name, value in RETURNING.items():
        spark.sparkContext.environment.setdefault(name, value)
