"""Reliable checkpoints for iterative operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def saved(df: DataFrame) -> DataFrame:
    """The rows written to the folder that spark.checkpoint.dir names. Where it is unset a local session gets a temporary
    one; a cluster must name a folder that all its nodes share."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="corpusloom-checkpoint-"))
    return df.checkpoint(eager=True)
