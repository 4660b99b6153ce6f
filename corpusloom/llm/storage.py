"""Reliable checkpoints in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: spark.checkpoint.dir as the session names it. Where it is unset a local session,
    whose executors are the driver, gets a temporary one; a cluster must name a folder that all its nodes share."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="corpusloom-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def saved(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder: what reads them no longer depends on any executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def saved_table(df: DataFrame) -> DataFrame:
    """The same as Parquet files, which are smaller than a checkpoint's rows."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of saved tables that nothing reads any more."""
    for df in tables:
        for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
            remove(df.sparkSession, folder)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
