"""Distribution drift of text: lengths, characters, vocabulary; PSI, Jensen-Shannon divergence, verdicts."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import HANGUL, SPACES, TOKEN

# Upper bounds of the length bins, and the thresholds of the three scores.
LENGTH_BOUNDS = (10, 50, 100, 200, 500, 1000)
THRESHOLDS = {"length_psi": 0.25, "vocab_js": 0.30, "char_shift": 0.20}
EPSILON = 1e-6


def length_bin(text: Column) -> Column:
    """0 for the shortest texts up to the number of bounds for the longest."""
    out = F.lit(len(LENGTH_BOUNDS))
    for i, bound in reversed(list(enumerate(LENGTH_BOUNDS))):
        out = F.when(F.length(text) < bound, i).otherwise(out)
    return out


def length_histogram(texts: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """(by..., bin, n), empty bins included."""
    counts = texts.groupBy(*by).agg(*[F.count_if(length_bin(F.col(text)) == i).alias(f"b{i}") for i in range(len(LENGTH_BOUNDS) + 1)])
    return counts.select(*by, F.posexplode(F.array(*[f"b{i}" for i in range(len(LENGTH_BOUNDS) + 1)])).alias("bin", "n"))


def character_ratios(texts: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """Shares of Hangul, ASCII letters, digits and other characters among those that are no white space."""
    bare = F.regexp_replace(F.col(text), SPACES, "")
    sums = texts.groupBy(*by).agg(
        F.sum(F.length(bare)).alias("total"), F.sum(F.regexp_count(bare, F.lit(HANGUL))).alias("ko"), F.sum(F.regexp_count(bare, F.lit("[A-Za-z]"))).alias("en"), F.sum(F.regexp_count(bare, F.lit(r"\p{Nd}"))).alias("digit")
    )
    total = F.greatest(F.col("total"), F.lit(1))
    return sums.select(*by, *[(F.col(c) / total).alias(c) for c in ("ko", "en", "digit")], ((F.col("total") - F.col("ko") - F.col("en") - F.col("digit")) / total).alias("other"))


def vocabulary(texts: DataFrame, by: list[str], top: int = 50, text: str = "text") -> DataFrame:
    """(by..., token, n): the most frequent tokens of each group, ties by token."""
    tokens = texts.select(*by, F.explode(F.regexp_extract_all(F.col(text), F.lit(TOKEN), F.lit(0))).alias("token"))
    counts = tokens.groupBy(*by, F.lower("token").alias("token")).agg(F.count("*").alias("n"))
    if not by:
        return counts.orderBy(F.desc("n"), "token").limit(top)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "token"))
    return counts.withColumn("_r", rank).where(F.col("_r") <= top).drop("_r")


def psi(reference: Column, current: Column) -> Column:
    """One bin's share of the population stability index."""
    r, c = F.greatest(reference, F.lit(EPSILON)), F.greatest(current, F.lit(EPSILON))
    return (c - r) * F.log(c / r)


def summarize(texts: DataFrame, by: list[str], text: str = "text", empty: bool = False) -> DataFrame:
    """(by..., n, avg_len, bins, chars) in one pass: texts, their mean length, numbers for each length bin, and numbers of
    Hangul, ASCII letters, digits and all characters that are no white space. Empty texts are left out unless `empty`."""
    t, bare = F.col(text), F.regexp_replace(F.col(text), SPACES, "")
    full = texts if empty else texts.where(F.coalesce(t, F.lit("")) != "")
    binned = F.array(*[F.count_if(length_bin(t) == i) for i in range(len(LENGTH_BOUNDS) + 1)])
    counted = F.struct(F.sum(F.regexp_count(bare, F.lit(HANGUL))).alias("ko"), F.sum(F.regexp_count(bare, F.lit("[A-Za-z]"))).alias("en"), F.sum(F.regexp_count(bare, F.lit(r"\p{Nd}"))).alias("digit"), F.sum(F.length(bare)).alias("total"))
    return full.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(F.length(t)), 4).alias("avg_len"), binned.alias("bins"), counted.alias("chars"))


def _shares(chars: Column) -> dict[str, Column]:
    total = F.greatest(chars["total"], F.lit(1))
    parts = {c: chars[c] / total for c in ("ko", "en", "digit")}
    return parts | {"other": (chars["total"] - chars["ko"] - chars["en"] - chars["digit"]) / total}


def length_psi_of(bins: Column, against: Column) -> Column:
    """PSI of a histogram against another."""
    total = lambda b: F.greatest(F.aggregate(b, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(1))
    parts = F.zip_with(bins, against, lambda c, r: psi(r / total(against), c / total(bins)))
    return F.round(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x), 4)


def character_shift_of(chars: Column, against: Column) -> Column:
    """The largest change of a character share."""
    a, b = _shares(chars), _shares(against)
    return F.round(F.greatest(*[F.abs(a[c] - b[c]) for c in a]), 4)


def _against(current: DataFrame, reference: DataFrame) -> DataFrame:
    """Summaries beside the one row of the reference's."""
    return current.crossJoin(F.broadcast(reference.select(F.col("bins").alias("ref_bins"), F.col("chars").alias("ref_chars"))))


def length_psi(reference: DataFrame, current: DataFrame, by: list[str]) -> DataFrame:
    """PSI of the length histogram of each group of current against that of reference as a whole."""
    return _against(summarize(current, by), summarize(reference, [])).select(*by, length_psi_of(F.col("bins"), F.col("ref_bins")).alias("length_psi"))


def vocabulary_js(reference: DataFrame, current: DataFrame, by: list[str], top: int = 50) -> DataFrame:
    """Jensen-Shannon divergence, in bits, of each group's vocabulary against reference's. Only the `top` tokens of each
    side are joined."""
    ref = vocabulary(reference, [], top).select("token", F.col("n").alias("r"))
    cur = vocabulary(current, by, top).select(*by, "token", F.col("n").alias("c"))
    full = current.select(*by).distinct().crossJoin(F.broadcast(ref)).join(cur, [*by, "token"], "full_outer").fillna(0, ["r", "c"])
    along = Window.partitionBy(*(by or [F.lit(1)]))
    p, q = F.col("r") / F.greatest(F.sum("r").over(along), F.lit(1)), F.col("c") / F.greatest(F.sum("c").over(along), F.lit(1))
    shares = full.select(*by, p.alias("p"), q.alias("q"))
    m = F.greatest((F.col("p") + F.col("q")) / 2, F.lit(EPSILON))
    part = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    return shares.groupBy(*by).agg(F.round(0.5 * F.sum(part(F.col("p"))) + 0.5 * F.sum(part(F.col("q"))), 4).alias("vocab_js"))


def character_shift(reference: DataFrame, current: DataFrame, by: list[str]) -> DataFrame:
    """The largest change of a character share."""
    return _against(summarize(current, by), summarize(reference, [])).select(*by, character_shift_of(F.col("chars"), F.col("ref_chars")).alias("char_shift"))


def drift(reference: DataFrame, current: DataFrame, by: list[str], thresholds: dict[str, float] = THRESHOLDS, least: int = 30, empty: bool = False) -> DataFrame:
    """The three scores of each group and the verdict: drift, stable or insufficient_sample. Each side is summed up once,
    and read once more for its vocabulary. Empty texts are left out unless `empty`."""
    full = lambda df: df if empty else df.where("coalesce(text, '') <> ''")
    ref, cur = summarize(reference, [], empty=empty), summarize(current, by, empty=empty)
    scores = _against(cur, ref).select(*by, "n", length_psi_of(F.col("bins"), F.col("ref_bins")).alias("length_psi"), character_shift_of(F.col("chars"), F.col("ref_chars")).alias("char_shift"))
    out = scores.join(vocabulary_js(full(reference), full(current), by), by).select(*by, "n", "length_psi", "vocab_js", "char_shift")
    above = F.lit(False)
    for name, limit in thresholds.items():
        above = above | (F.col(name) > limit)
    return out.withColumn("verdict", F.when(F.col("n") < least, "insufficient_sample").when(above, "drift").otherwise("stable"))


@dataclass
class Trigger:
    """What a baseline's next check depends on: when it last triggered, and whether that run is still going."""

    last: int | None = None
    running: bool = False

    def take(self, at: int, said: str | None, cooldown: int) -> bool:
        """Whether a row triggers: a check of drift, `cooldown` seconds or more after the last trigger, while no run of it
        is going. "started" and "finished" rows are of runs; a trigger starts one if runs are told at all."""
        if said in ("started", "finished"):
            self.running = said == "started"
            return False
        if said != "drift" or self.running or (self.last is not None and at - self.last < cooldown):
            return False
        self.last = at
        return True


def retrain_triggers(checks: DataFrame, cooldown: int = 600, baseline: str = "baseline", at: str = "at", verdict: str = "verdict") -> DataFrame:
    """(baseline, at, drift, triggered) for checks: triggered are those of drift, of each baseline, that come `cooldown`
    seconds or more after the last one that did, and not while a run is going. Verdicts "started" and "finished" tell of runs.

    Which one triggers depends on those before, so a baseline's checks are read in order; one task holds no more of
    them than a batch, and two facts. Checks of one time count in the order of their verdicts.
    """
    kinds = {c: checks.schema[c].dataType.simpleString() for c in (baseline, at)}

    def run(batches):
        key, state = None, Trigger()
        for rows in batches:
            out = []
            for b, second, said in zip(rows[baseline], rows["_s"], rows["_v"], strict=True):
                if key is None or b != key[0]:
                    key, state = (b,), Trigger()
                out.append(state.take(int(second), said, cooldown))
            yield pd.DataFrame({baseline: rows[baseline], at: rows[at], "drift": rows["_v"] == "drift", "triggered": out})

    rows = checks.where(F.col(baseline).isNotNull() & F.col(at).isNotNull()).select(baseline, at, F.unix_seconds(F.col(at).cast("timestamp")).alias("_s"), F.coalesce(verdict, F.lit("")).alias("_v"))
    sorted_ = rows.repartition(baseline).sortWithinPartitions(baseline, at, "_v")
    return sorted_.mapInPandas(run, f"`{baseline}` {kinds[baseline]}, `{at}` {kinds[at]}, drift boolean, triggered boolean")
