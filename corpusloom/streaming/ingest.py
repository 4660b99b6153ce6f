"""The ingest queue: an idempotent, versioned register of documents, written batch by batch.

The register is a table of changes, one folder for each batch; a batch that is repeated after a failure replaces its
own folder and nothing else, so it changes nothing. What holds now is the last change of each document and version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: From which status a document's version may go to which; None is a version not seen before.
TRANSITIONS = {None: ("queued",), "queued": ("running", "cancelled"), "running": ("done", "failed"), "failed": ("queued",), "done": (), "cancelled": ("queued",)}
CHANGES = "doc_id string, version int, status string, sha string, error string, ord long, epoch long"


def allowed(before: Column, after: Column) -> Column:
    """Whether a status may follow another."""
    out = F.when(before.isNull(), after.isin(*TRANSITIONS[None]))
    for status, following in TRANSITIONS.items():
        if status is not None:
            out = out.when(before == status, after.isin(*following) if following else F.lit(False))
    return F.coalesce(out.otherwise(F.lit(False)), F.lit(False))


def changes(spark: SparkSession, path: str) -> DataFrame:
    """All changes of a register; none where nothing has been written yet."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        return spark.createDataFrame([], CHANGES)
    return spark.read.schema(CHANGES).parquet(path)


def current(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The last change of each document and version, before a batch if one is named."""
    rows = changes(spark, path)
    rows = rows if before is None else rows.where(F.col("epoch") < before)
    return rows.groupBy("doc_id", "version").agg(F.max_by(F.struct("status", "sha", "error", "ord", "epoch"), F.struct("epoch", "ord")).alias("x")).select("doc_id", "version", "x.*")


def _in_turn(rows: DataFrame, held: DataFrame) -> DataFrame:
    """rows with `before`, the status that each follows, and `ok`. Within a batch a row follows the one before it, as
    long as that was in turn itself: what follows a row out of turn is out of turn, too."""
    along = Window.partitionBy("doc_id", "version").orderBy("ord")
    known = held.select("doc_id", "version", F.col("status").alias("held"))
    joined = rows.join(known, ["doc_id", "version"], "left").withColumn("before", F.coalesce(F.lag("status").over(along), F.col("held")))
    step = allowed(F.col("before"), F.col("status"))
    return joined.withColumn("ok", F.min(step.cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0)) == 1).drop("held")


def upsert(path: str, dead: str, valid: Callable[[DataFrame], Column] = lambda rows: F.col("doc_id").isNotNull() & F.col("version").isNotNull()) -> Callable[[DataFrame, int], None]:
    """For foreachBatch, over rows (doc_id, version, status, sha, error, ord): those that are valid and in turn go to the
    register at `path`, the others to `dead` with a reason. Repeating an epoch writes the same rows again."""

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        checked = batch.withColumn("fine", F.coalesce(valid(batch), F.lit(False)))
        turned = _in_turn(checked.where("fine").drop("fine").dropDuplicates(["doc_id", "version", "ord"]), current(spark, path, before=epoch))
        cast = lambda rows: rows.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in CHANGES.split(", ")[:-1]], F.lit(epoch).cast("long").alias("epoch"))
        bad = checked.where("NOT fine").drop("fine").withColumn("reason", F.lit("invalid"))
        out = turned.where("NOT ok").withColumn("reason", F.concat(F.coalesce("before", F.lit("nothing")), F.lit(" to "), F.coalesce("status", F.lit("nothing")))).drop("before", "ok")
        _put(bad.unionByName(out).withColumn("epoch", F.lit(epoch).cast("long")), dead)
        _put(cast(turned.where("ok")), path)

    return run


def _put(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(path)


def work_off(path: str, work: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch, over documents (doc_id, version, ...): `work` gives (doc_id, version, error), null where it went
    well. Versions that an earlier batch has done are left out; each other one gets its changes queued, running, and done
    or failed. A batch that is repeated works on its own documents again and replaces its changes."""

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        held = current(spark, path, before=epoch)
        open_ = batch.join(held.where("status = 'done'").select("doc_id", "version"), ["doc_id", "version"], "left_anti")
        results = work(open_).select("doc_id", "version", "error")
        steps = F.array(F.lit("queued"), F.lit("running"), F.when(F.col("error").isNull(), "done").otherwise("failed"))
        rows = results.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("version").cast("int").alias("version"), F.posexplode(steps).alias("k", "status"), "error")
        _put(rows.select("doc_id", "version", "status", F.lit(None).cast("string").alias("sha"), F.when(F.col("k") == 2, F.col("error")).alias("error"), F.col("k").cast("long").alias("ord"), F.lit(epoch).cast("long").alias("epoch")), path)

    return run
