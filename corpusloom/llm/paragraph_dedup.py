"""Substring dedup by paragraph MinHash banding, with exact passages across paragraph bounds.

Paragraphs (lines of five words or more, so that each has a shingle) get MinHash band keys; those that share a key are candidates, exact Jaccard
of their five-word shingles decides, and components of what is linked are the clusters. Bands and rows are
tuned for recall: at a similarity of 0.8, nine bands of three rows miss a pair with a chance of 0.0016.

A repeated passage need not be a paragraph. Windows of 40 words get rolling hashes, and the least of every 11
neighbours is kept, so any passage of 50 words or more that stands in two places has a kept window in common,
be they in two documents or, without overlap, in one. The places of a window are its cluster, named by the
first document that has it, whose first place is kept; minima found before the shuffle and a join with the
repeated windows alone find them, so a window that stands everywhere is no group of its own. Kept windows in a row with the same first holder are
joined to spans; where that changes a new span starts, so spans of different clusters may overlap by less than
a window. No word is lost where all spans that are not kept are cut out: each of their words stands in an
earlier place too, and so on to the first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.components import Forest
from corpusloom.llm.near_sets import ROWS, Cut, Threshold, candidates_within, digest, set_components, sketches
from corpusloom.llm.storage import discard, saved, saved_table
from corpusloom.llm.textkit import _BACK, _ROOT, _powers, mix, spans, word_hashes

_U = np.uint64
OUT = "doc_id long, kind string, first_word long, n_words long, component_id long, kept boolean"


def band_keys(bands: int, rows: int, limit: Threshold | None = None):
    """MinHash band keys of sets of hashes; none of sets so small that no other set is within the limit."""
    seeds = mix(np.arange(1, bands * rows + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))
    odds = mix(seeds) | _U(1)
    place = mix(np.arange(1, rows + 1, dtype=_U))
    band = mix(np.arange(1001, 1001 + bands, dtype=_U))

    def keys_of(sets: list[np.ndarray]) -> list[np.ndarray]:
        out = [s[:0] for s in sets]
        some = [k for k, s in enumerate(sets) if len(s) and not (limit is not None and limit.stands_alone(len(s)))]
        i = 0
        while i < len(some):
            j, n = i, 0
            while j < len(some) and (j == i or n < 1 << 16):
                n += len(sets[some[j]])
                j += 1
            every = np.concatenate([sets[k] for k in some[i:j]])
            first = np.concatenate([[0], np.cumsum([len(sets[k]) for k in some[i : j - 1]])]).astype(np.int64)
            least = np.stack([np.minimum.reduceat((every ^ s) * odd, first) for s, odd in zip(seeds, odds, strict=True)], axis=1)
            keys = mix((least.reshape(-1, bands, rows) * place).sum(axis=2) + band)
            for k, key in zip(some[i:j], keys, strict=True):
                out[k] = key
            i = j
        return out

    return keys_of


def link_exact(sets: list[np.ndarray], limit: Threshold, sides: list[bool] | None = None) -> Forest:
    """Connects what is above the threshold by exact Jaccard; pairs already connected are not computed."""
    forest = Forest()
    if len(sets) < 2:
        return forest
    maybe = candidates_within(sets, limit)
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    for x, q in enumerate(order):
        for r in order[x + 1 :]:
            if not limit.sizes_fit(len(sets[q]), len(sets[r])):
                break
            if maybe[q, r] and (sides is None or sides[q] != sides[r]) and forest.find(q) != forest.find(r):
                common = len(np.intersect1d(sets[q], sets[r], assume_unique=True))
                if common >= limit.overlap(len(sets[q]) + len(sets[r])):
                    forest.join(q, r)
    return forest


def _paragraphs(cut: Cut, keys_of):
    """ROWS of each paragraph with its tokens."""

    def run(batches):
        names = [f.split()[0] for f in f"{ROWS}, tokens".split(", ")]
        for batch in batches:
            ids, refs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            units = list(cut.units(batch.column(2)))
            sets = [u.elements for u in units]
            rows = [(ids[u.row], refs[u.row], u.line, u.first_word, u.n_words, len(u.elements), digest(u.elements), p) for u, p in zip(units, sketches(sets), strict=True)]
            cols = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            keys = keys_of(sets)
            ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*keys, np.zeros(0, dtype=_U)]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), tokens], names)

    return run


def _sliding(op, x: np.ndarray, width: int) -> np.ndarray:
    """op over every run of width values, by doubling."""
    have, out = 1, x
    while have * 2 <= width:
        out = op(out[:-have], out[have:])
        have *= 2
    return op(out[: len(out) - (width - have)], out[width - have :]) if have < width else out


def winnow(words: np.ndarray, window: int, among: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of the windows that are the least of `among` neighbours, each place of equal hashes."""
    n = len(words)
    if n < window + among - 1:
        return np.zeros(0, dtype=_U), np.zeros(0, dtype=np.int64)
    total = np.zeros(n + 1, dtype=_U)
    np.cumsum(words * _powers(_ROOT, n)[:n], out=total[1:])
    r = mix((total[window:] - total[:-window]) * _powers(_BACK, n)[: n - window + 1])
    low = _sliding(np.minimum, r, among)
    edge = np.zeros(among - 1, dtype=_U)
    top = _sliding(np.maximum, np.concatenate([edge, low, edge]), among)
    at = np.flatnonzero(top == r)
    return r[at], at


def _windows(window: int, among: int):
    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), batch.column(1)
            prints, docs, places = [], [], []
            for row, data, bounds in spans(texts):
                words, at = word_hashes(data, bounds)
                for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                    value, first = winnow(words[a:b], window, among)
                    prints.append(value)
                    places.append(first)
                    docs.append(np.full(len(value), ids[row + k]))
            if prints:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(prints).view(np.int64)), pa.array(np.concatenate(docs).astype(np.int64)), pa.array(np.concatenate(places).astype(np.int32))], ["print", "doc_id", "pos"])

    return run


def repeated_places(prints: DataFrame, window: int) -> DataFrame:
    """(doc_id, pos, first, own) of the places of each print that has copies: the document that has it first, and
    whether this place is the first. A copy is a place in another document, or one in the same document that doesn't
    overlap the first place; what overlaps it is the same text and is left out.
    """
    # Saved by themselves, both sides of a join are dealt for it alone, so that a print that stands everywhere is split.
    # As Parquet they take a fraction of a checkpoint's disk.
    many = saved_table(prints.groupBy("print").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("first <> last OR n > 1").drop("n"))
    held = saved_table(prints.join(many, "print"))
    discard(many)
    starts = held.where("doc_id = first").groupBy("print").agg(F.min("pos").alias("start"), F.max("pos").alias("end"))
    copied = F.col("end") >= F.col("start") + window
    starts = saved_table(starts.select("print", "start", copied.alias("again")))
    first_place = (F.col("doc_id") == F.col("first")) & (F.col("pos") == F.col("start"))
    shown = (F.col("doc_id") != F.col("first")) | (F.col("pos") >= F.col("start") + window) | (first_place & (F.col("again") | (F.col("first") != F.col("last"))))
    return held.join(starts, "print").where(shown).select("doc_id", "pos", "first", first_place.alias("own"))


def _spans(window: int):
    """Rows in order of (doc_id, pos): windows of a document that overlap, with the same first holder and all first places
    or all copies, as one span."""

    def run(batches):
        open_, out = None, []

        def closed():
            doc, start, end, first, own = open_
            out.append((doc, "passage", start, end - start, first, own))

        def packed():
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "kind", "first_word", "n_words", "component_id", "kept"])

        for batch in batches:
            for doc, pos, first, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if open_ and open_[0] == doc and open_[3:] == (first, own) and pos <= open_[2]:
                    open_ = (doc, open_[1], max(open_[2], pos + window), first, own)
                else:
                    if open_:
                        closed()
                    open_ = (doc, pos, pos + window, first, own)
            if out:
                yield packed()
                out = []
        if open_:
            closed()
            yield packed()

    return run


def repeated_passages(docs: DataFrame, *, window: int = 40, among: int = 11) -> DataFrame:
    """OUT rows of kind passage: the spans of windows that repeat, named by their first document; their first place is kept.

    Documents must have ids, and rows that share one are one document. Texts of fewer than window + among - 1 words,
    and null ones, have no windows. An empty table gives no rows.
    """
    prints = saved_table(docs.select("doc_id", "text").mapInArrow(_windows(window, among), "print long, doc_id long, pos int"))
    rows = repeated_places(prints, window)
    discard(prints)  # the places are saved by now
    return rows.repartition("doc_id").sortWithinPartitions("doc_id", "pos").mapInArrow(_spans(window), OUT)


def repeated_paragraphs(docs: DataFrame, *, words: int = 5, num: int = 80, den: int = 100, least_words: int = 5, bands: int = 9, rows: int = 3, chunk_sets: int = 256, chunk_words: int = 1 << 20) -> DataFrame:
    """OUT rows of kind paragraph: members of clusters of two or more, named by the smallest id; the first is kept.

    Documents without an id are left out; null texts have no paragraphs, and lines of fewer than least_words words
    are none. A paragraph may repeat within a document. An empty table gives no rows.
    """
    cut, limit = Cut(words, by_lines=True, least_words=least_words), Threshold(num, den)
    docs = docs.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("ref"), "text")
    units = saved_table(docs.mapInArrow(_paragraphs(cut, band_keys(bands, rows, limit)), f"{ROWS}, tokens array<long>"))
    linked = set_components(docs, units, cut, None, limit, link_exact, chunk_sets=chunk_sets, chunk_words=chunk_words)
    per_node = units.groupBy("node").agg(F.min(F.struct("doc_id", "first_word")).alias("least"), F.count("*").alias("copies"))
    named = per_node.join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    clusters = named.groupBy("root").agg(F.min("least").alias("first"), F.sum("copies").alias("all")).where("all > 1")
    names = saved(named.join(clusters, "root").select(F.col("node").alias("of"), "first"))
    out = units.join(names, units.node == names.of)
    return out.select("doc_id", F.lit("paragraph").alias("kind"), "first_word", "n_words", F.col("first.doc_id").alias("component_id"), (F.struct("doc_id", "first_word") == F.col("first")).alias("kept"))


def find_repeats(docs: DataFrame, **how) -> DataFrame:
    """doc_id, kind, first_word, n_words, component_id, kept: every paragraph and passage that repeats.

    first_word and n_words count words free of white space from 0. component_id is the smallest document id of
    the cluster. Rows without an id can't be named and are left out; null, empty and short texts have nothing
    to repeat. Rows that repeat an id are one document: a passage must be in two documents, a paragraph may
    repeat within one. Whole texts are read, other columns are not. Empty tables give no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")
    return repeated_paragraphs(rows, **how).unionByName(repeated_passages(rows))
