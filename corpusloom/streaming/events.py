"""Streaming forms: sliding limiter, windowed counts with late data, drift cycles, idempotent registers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusloom.operators.control import limit_times
from corpusloom.operators.drift import drift


def event_time(events: DataFrame, ts: str = "ts") -> DataFrame:
    """Watermarks need a TIMESTAMP; naive times are taken in the session's zone."""
    return events.withColumn(ts, F.col(ts).cast("timestamp"))


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes", slide: str | None = None, by: str = "event_type") -> DataFrame:
    """Counts and sums of tumbling or sliding windows; rows later than the watermark are left out."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return event_time(events).withWatermark("ts", late).groupBy(window.alias("window"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), by, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", by: str = "user_id") -> DataFrame:
    session = F.session_window("ts", gap)
    return event_time(events).withWatermark("ts", late).groupBy(session.alias("session"), by).agg(F.count("*").alias("n")).select(by, F.col("session.start").alias("start"), F.col("session.end").alias("end"), "n")


def sliding_limiter(events: DataFrame, limit: int, seconds: int = 60, tenant: str = "tenant") -> DataFrame:
    """Accepted and refused events of each tenant; its state is the times that still count, `limit` at most."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["us", "event_id"])
        accepted, held = limit_times([int(t) for t in rows["us"]], limit, seconds * 1_000_000, held)
        state.update((held,))
        yield pd.DataFrame({"tenant": [key[0]] * len(rows), "event_id": rows["event_id"].to_numpy(), "accepted": accepted})

    rows = event_time(events).select(F.col(tenant).cast("string").alias("tenant"), "event_id", F.unix_micros("ts").alias("us"))
    return rows.groupBy("tenant").applyInPandasWithState(step, "tenant string, event_id long, accepted boolean", "held array<long>", "append", GroupStateTimeout.NoTimeout)


def drift_cycle(reference: DataFrame, sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch of texts against a fixed reference, the verdict handed to sink."""

    def run(batch: DataFrame, epoch: int) -> None:
        if not batch.isEmpty():
            sink(drift(reference, batch.withColumn("all", F.lit("all")), ["all"]).drop("all").withColumn("epoch", F.lit(epoch)), epoch)

    return run


def dead_letter(work: Callable[[DataFrame], DataFrame], valid: Callable[[DataFrame], object], done: str, dead: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: valid rows are worked on and appended to done, the rest to dead; an epoch that is repeated
    after a failure replaces its own partition."""

    def run(batch: DataFrame, epoch: int) -> None:
        checked = batch.withColumn("_ok", F.coalesce(valid(batch), F.lit(False)))
        put = lambda rows, path: rows.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(path)
        put(work(checked.where("_ok").drop("_ok")), done)
        put(checked.where("NOT _ok").drop("_ok"), dead)

    return run
