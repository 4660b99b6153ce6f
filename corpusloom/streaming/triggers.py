"""Triggers of retraining on a stream of drift checks: state for each baseline, kept over batches and restarts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusloom.operators.drift import Trigger

STATE = "last long, running boolean"
OUT = "baseline string, at timestamp, drift boolean, triggered boolean"


def trigger_stream(checks: DataFrame, cooldown: int = 600, forget: str | None = None, baseline: str = "baseline", at: str = "at", verdict: str = "verdict") -> DataFrame:
    """What operators.drift.retrain_triggers gives, on a stream: cooldown and guard hold across batches.

    A baseline's rows are taken in the order of their times within a batch, and batch by batch; a row that comes in a
    later batch than a younger one counts as late and can't trigger before what has triggered. With `forget`, a
    duration not shorter than the cooldown, the state of a baseline without rows for so long is dropped.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = Trigger(*state.get) if state.exists else Trigger()
        rows = pd.concat(list(batches)).sort_values(["at", "verdict"], kind="stable")
        out = [held.take(int(s), v, cooldown) for s, v in zip(rows["second"], rows["verdict"], strict=True)]
        state.update((held.last, held.running))
        if forget:
            state.setTimeoutDuration(forget)
        yield pd.DataFrame({"baseline": key[0], "at": rows["at"].to_numpy(), "drift": (rows["verdict"] == "drift").to_numpy(), "triggered": out})

    time = F.col(at).cast("timestamp")
    rows = checks.select(F.col(baseline).cast("string").alias("baseline"), time.alias("at"), F.unix_seconds(time).alias("second"), F.coalesce(F.col(verdict).cast("string"), F.lit("")).alias("verdict")).where("baseline IS NOT NULL AND at IS NOT NULL")
    return rows.groupBy("baseline").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if forget else GroupStateTimeout.NoTimeout)
