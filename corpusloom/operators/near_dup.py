"""Near duplicates by MinHash bands over word sets, exact verification, and the greedy keep-first rule."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from corpusloom.functions.text import SPACES
from corpusloom.sources.checkpoints import saved

WORDS = r"[\p{L}\p{N}_]+"


def word_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0)))


def _minima(bands: int, rows: int):
    seeds = np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
    place = np.arange(3, 2 * rows + 3, 2, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)

    @F.pandas_udf(ArrayType(LongType()))
    def keys(hashes: pd.Series) -> pd.Series:
        """One number for each band: of the minima of `rows` keyed hashes of the words. Words are hashed in the JVM,
        minima are taken in Arrow batches; as expressions they would read each list bands * rows times over."""
        out = []
        for h in hashes:
            x = np.asarray(h, dtype=np.int64).view(np.uint64)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            least = ((x[None, :] ^ (x[None, :] >> np.uint64(32))) * seeds[:, None]).min(axis=1).reshape(bands, rows)
            out.append((least * place).sum(axis=1).view(np.int64))
        return pd.Series(out)

    return keys


def word_classes(records: DataFrame, id_column: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rep, words) of each set of words, rep being the smallest id of it and words their hashes, and (rep, id) of the
    ids besides. Records without words are left out."""
    words = F.array_sort(word_set(F.col(text)))
    sets = records.select(F.col(id_column).alias("id"), words.alias("w")).where(F.size("w") > 0).select("id", F.sha2(F.array_join("w", " "), 256).alias("key"), F.transform("w", lambda w: F.xxhash64(w)).alias("words"))
    keyed = saved(sets.groupBy("key").agg(F.min("id").alias("rep"), F.first("words").alias("words")))
    copies = sets.select("id", "key").join(keyed.select("key", "rep"), "key").where("id <> rep").select("rep", "id")
    return keyed.select("rep", "words"), copies


def band_table(classes: DataFrame, bands: int, rows: int) -> DataFrame:
    """(rep, size, band, hash) of classes (rep, words)."""
    return classes.select("rep", F.size("words").alias("size"), F.posexplode(_minima(bands, rows)(F.col("words"))).alias("band", "hash"))


def verified(met: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b, jaccard) of met (a, b) whose word sets reach the threshold."""
    held = lambda side, name: classes.select(F.col("rep").alias(side), F.col("words").alias(name))
    both = met.join(held("a", "wa"), "a").join(held("b", "wb"), "b")
    common = F.size(F.array_intersect("wa", "wb"))
    return both.withColumn("jaccard", common / (F.size("wa") + F.size("wb") - common)).where(F.col("jaccard") >= threshold).select("a", "b", F.round("jaccard", 4).alias("jaccard"))


def _may_reach(size: Column, other: Column, threshold: float) -> Column:
    """Sets of such sizes can reach the threshold."""
    return F.least(size, other) >= threshold * F.greatest(size, other) - 1e-9


def similar_classes(classes: DataFrame, threshold: float = 0.85, bands: int = 16, rows: int = 5) -> DataFrame:
    """(a, b, jaccard) with a < b of classes (rep, words) at or above the threshold: every such pair, so a family of n
    gives n * (n - 1) / 2. Only keys and sizes meet in the bands; keep_first asks for no pairs."""
    banded = band_table(classes, bands, rows)
    x, y = banded.alias("x"), banded.alias("y")
    met = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.hash") == F.col("y.hash")) & (F.col("x.rep") < F.col("y.rep")) & _may_reach(F.col("x.size"), F.col("y.size"), threshold))
    return verified(met.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct(), classes, threshold)


def similar_pairs(records: DataFrame, threshold: float = 0.85, bands: int = 16, rows: int = 5, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(a, b, jaccard) with a < b: the pairs of different word sets at or above the threshold, each set by its first
    record, and each first record with the others of its set. So N copies give N - 1 rows, and no link is lost."""
    classes, copies = word_classes(records, id_column, text)
    return similar_classes(classes, threshold, bands, rows).unionByName(copies.select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("jaccard")))


def keepers(records: DataFrame, threshold: float = 0.85, bands: int = 16, rows: int = 5, id_column: str = "doc_id", text: str = "text", widest: int = 64) -> DataFrame:
    """(id, keeper) for the records that the sequential rule drops: in the order of ids a record is kept unless it is
    like one kept before, its keeper (the first such one that a round finds). Records without words are kept.

    No pairs of a group are made: in each round the first open sets of each band key are compared with what follows
    them there. A set that is among the first in all of its bands has met all before it, so it is kept once no open one
    of those is like it, and what is like a kept one goes. A family of any size is settled by its first member. The
    number of first sets grows from 1 to `widest` for keys that many unlike sets share; each round settles the smallest
    open set at least. What is open, and what has gone, are saved tables.
    """
    classes, copies = word_classes(records, id_column, text)
    open_ = saved(band_table(classes, bands, rows))
    gone, width = [], 1
    while not open_.isEmpty():
        first = open_.withColumn("place", F.row_number().over(Window.partitionBy("band", "hash").orderBy("rep"))).where(F.col("place") <= width).select("band", "hash", F.col("rep").alias("a"), F.col("size").alias("a_size"))
        first = saved(first)
        ready = first.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") == bands).select("a")
        met = open_.join(first, ["band", "hash"]).where((F.col("a") < F.col("rep")) & _may_reach(F.col("size"), F.col("a_size"), threshold)).select("a", F.col("rep").alias("b")).distinct()
        edges = saved(verified(met, classes, threshold).select("a", "b"))
        kept = saved(ready.join(edges.select(F.col("b").alias("a")), "a", "left_anti"))
        dropped = saved(edges.join(kept, "a").groupBy("b").agg(F.min("a").alias("keeper")))
        gone.append(dropped)
        settled = kept.select(F.col("a").alias("rep")).unionByName(dropped.select(F.col("b").alias("rep")))
        open_ = saved(open_.join(settled, "rep", "left_anti"))
        width = min(widest, width * 4)
    far = functools.reduce(DataFrame.unionByName, gone) if gone else classes.select(F.col("rep").alias("b"), F.col("rep").alias("keeper")).limit(0)
    near = copies.join(far.withColumnRenamed("b", "rep"), "rep", "left").select("id", F.coalesce("keeper", "rep").alias("keeper"))
    return far.select(F.col("b").alias("id"), "keeper").unionByName(near)


def keep_first(records: DataFrame, threshold: float = 0.85, id_column: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """Records without those that are like an earlier kept one."""
    dropped = keepers(records, threshold, id_column=id_column, text=text, **how)
    return records.join(dropped.select(F.col("id").alias("_gone")), F.col(id_column) == F.col("_gone"), "left_anti")


def contained(docs: DataFrame, items: DataFrame, words: int = 5) -> DataFrame:
    """(item_id, doc_id) where an item's text stands in a document, white space squeezed.

    Items are the smaller side: a document meets an item where it holds the item's first words in a row, so
    only equal runs are joined and containment is checked on what meets.
    """
    flat = lambda c: F.regexp_replace(c, SPACES, " ")
    item = items.select("item_id", F.trim(flat(F.col("text"))).alias("item")).where(F.length("item") > 0).withColumn("w", F.split("item", " "))
    # A first and a last word may be a part of a longer word of the document, so the run starts at the second.
    item = item.withColumn("run", F.when(F.size("w") >= words + 2, F.array_join(F.slice("w", 2, words), " ")))
    # Shorter items meet by the longest of their inner words; only those of one or two words have none.
    inner = F.when(F.size("w") > 2, F.slice("w", 2, F.greatest(F.size("w") - 2, F.lit(1))))
    item = item.withColumn("inner", F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"])
    doc = docs.select("doc_id", flat(F.col("text")).alias("doc"))
    split = doc.withColumn("w", F.split("doc", " "))
    size = F.size("w")
    runs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(size - words + 1, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(F.col("w"), i, F.lit(words)), " "))))
    by_run = split.select("doc_id", "doc", F.explode(runs).alias("h")).join(item.where("run IS NOT NULL").select("item_id", "item", F.xxhash64("run").alias("h")), "h").where(F.contains("doc", "item"))
    by_word = split.select("doc_id", "doc", F.explode(F.array_distinct("w")).alias("inner")).join(item.where("run IS NULL AND inner IS NOT NULL").select("item_id", "item", "inner"), "inner").where(F.contains("doc", "item"))
    least = doc.join(item.where("run IS NULL AND inner IS NULL").select("item_id", "item"), F.contains("doc", "item"))
    return by_run.select("item_id", "doc_id").unionByName(by_word.select("item_id", "doc_id")).unionByName(least.select("item_id", "doc_id"))
