"""Control-plane analytics: ledgers, limits, registries, traces, audit, access, canary weights."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def month_to_date(ledger: DataFrame, now: Column, tenant: str = "tenant", ts: str = "ts", cost: str = "cost") -> DataFrame:
    """Spend of each tenant from the start of now's month up to now."""
    return ledger.where((F.col(ts) >= F.date_trunc("month", now)) & (F.col(ts) <= now)).groupBy(tenant).agg(F.sum(cost).alias("spend"), F.count("*").alias("n"))


def price_usage(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """usage (model, n_in, n_out) with its cost; unknown models cost nothing."""
    cost = F.col("n_in") * F.coalesce("price_in", F.lit(0.0)) + F.col("n_out") * F.coalesce("price_out", F.lit(0.0))
    return usage.join(prices.select("model", "price_in", "price_out"), "model", "left").withColumn("cost", cost).drop("price_in", "price_out")


def authorize(allowed: Column, rpm_ok: Column, within_budget: Column) -> Column:
    """The first rule that a request breaks: model, rate, budget; else allowed."""
    return F.when(~allowed, "model_not_allowed").when(~rpm_ok, "rate_limited").when(~within_budget, "budget_exceeded").otherwise("allowed")


def limit_times(times: list[int], limit: int, window_us: int, held: list[int] | None = None) -> tuple[list[bool], list[int]]:
    """Which events in order pass a sliding limit; a refused event is not held, one exactly at the window's edge is."""
    held, out, start = list(held or []), [], 0
    for t in times:
        while start < len(held) and held[start] < t - window_us:
            start += 1
        ok = len(held) - start < limit
        if ok:
            held.append(t)
        out.append(ok)
    return out, held[start:]


def sliding_limit(events: DataFrame, limit: int, seconds: int = 60, tenant: str = "tenant", ts: str = "ts", event_id: str = "event_id") -> DataFrame:
    """(tenant, event_id, accepted) by the exact limiter. Whether an event passes depends on earlier decisions, so
    each tenant's events are read once in order; rows stream through, and a tenant's state is `limit` times at most."""

    def run(batches):
        tenant_now, held = None, []
        for pdf in batches:
            out = []
            for who, _, us in zip(pdf["tenant"], pdf["event_id"], pdf["us"], strict=True):
                if who != tenant_now:
                    tenant_now, held = who, []
                ok, held = limit_times([us], limit, seconds * 1_000_000, held)
                out.append(ok[0])
            yield pd.DataFrame({"tenant": pdf["tenant"], "event_id": pdf["event_id"], "accepted": out})

    rows = events.select(F.col(tenant).alias("tenant"), F.col(event_id).alias("event_id"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"))
    kind = dict(rows.dtypes)
    return rows.repartition("tenant").sortWithinPartitions("tenant", "us", "event_id").mapInPandas(run, f"tenant {kind['tenant']}, event_id {kind['event_id']}, accepted boolean")


def latest(log: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key of an append log."""
    return log.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")


def prefer_live(live: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Full outer join in which a live row's values go before the stored ones."""
    a, b = live.alias("a"), stored.alias("b")
    return a.join(b, key, "full_outer").select(key, *[F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c) for c in live.columns if c != key])


def trace_summary(spans: DataFrame, trace: str = "trace_id") -> DataFrame:
    """spans (trace_id, start_us, end_us, error, tokens, ord): number, duration in ms, any error, first tokens."""
    first = F.min_by("tokens", F.when(F.col("tokens").isNotNull(), F.col("ord")))
    return spans.groupBy(trace).agg(F.count("*").alias("spans"), ((F.max("end_us") - F.min("start_us")) / 1000).alias("duration_ms"), F.bool_or("error").alias("error"), first.alias("tokens"))


def hit_rate(requests: DataFrame, hit: Column) -> DataFrame:
    return requests.agg(F.count("*").alias("n"), F.round(F.coalesce(F.avg(hit.cast("double")), F.lit(0.0)), 4).alias("hit_rate"))


def tail(log: DataFrame, order: list[Column], n: int) -> DataFrame:
    return log.orderBy(*order).limit(n)


def page(rows: DataFrame, order: list[Column], offset: int, n: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(n)


def active_keys(keys: DataFrame, now: Column) -> DataFrame:
    """Keys neither revoked nor past their expiry."""
    return keys.where(F.col("revoked_at").isNull() & (F.col("expires_at").isNull() | (F.col("expires_at") > now)))


def permissions(users: DataFrame, roles: DataFrame) -> DataFrame:
    """users (user, roles array) with the distinct permissions of their roles (role, permission)."""
    return users.select("user", F.explode("roles").alias("role")).join(roles, "role").groupBy("user").agg(F.array_sort(F.collect_set("permission")).alias("permissions"))


def release_state(events: DataFrame) -> DataFrame:
    """events (release_id, ord, kind, actor): the last state of each release, and whether whoever approved it had not requested it."""
    state = events.groupBy("release_id").agg(F.max_by("kind", "ord").alias("state"), F.min_by("actor", F.when(F.col("kind") == "request", F.col("ord"))).alias("requester"), F.max_by("actor", F.when(F.col("kind") == "approve", F.col("ord"))).alias("approver"))
    return state.withColumn("separate", F.coalesce(F.col("requester") != F.col("approver"), F.lit(True)))


def canary_weights(entries: DataFrame, share: float) -> DataFrame:
    """entries (model, rollout): the canaries of a model share `share` of its traffic evenly, the stable ones the rest."""
    n = F.count("*").over(Window.partitionBy("model", "rollout"))
    kinds = F.size(F.collect_set("rollout").over(Window.partitionBy("model")))
    whole = F.when(kinds == 1, 1.0).when(F.col("rollout") == "canary", share).otherwise(1 - share)
    return entries.withColumn("weight", F.round(whole / n, 6))


def register_documents(known: DataFrame, incoming: DataFrame) -> DataFrame:
    """incoming (doc_id, sha) against known (doc_id, sha, version): new, changed (version + 1) or unchanged."""
    old = known.select("doc_id", F.col("sha").alias("_sha"), F.col("version").alias("_version"))
    joined = incoming.join(old, "doc_id", "left")
    status = F.when(F.col("_sha").isNull(), "new").when(F.col("_sha") != F.col("sha"), "changed").otherwise("unchanged")
    version = F.when(F.col("_sha").isNull(), 1).when(F.col("_sha") != F.col("sha"), F.col("_version") + 1).otherwise(F.col("_version"))
    return joined.select("doc_id", "sha", version.cast("int").alias("version"), status.alias("status"))
