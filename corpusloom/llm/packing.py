"""Packing by minimum bin slack.

Every document becomes its ids and one end id. Pieces of a whole window stand alone; what is left of each
document, 1 to capacity - 1 ids, is packed by the minimum-bin-slack rule: the longest remainder opens a window
and a bitset subset-sum over the multiset of remaining lengths picks what fills it closest to capacity,
backtracked to counts for each length. A filling is repeated as often as the counts allow, so the plan has
at most about one step for each length, however many documents there are. Only the histogram of lengths (at
most `capacity` rows) and the number of whole windows reach the driver.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.storage import saved
from corpusloom.llm.tokenization import default_vocabulary, encoder

TOKENIZED = "doc_id long, doc_tokens long, part int, full_before long, rest long, rest_rank long, crcs array<long>"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@dataclass(frozen=True)
class Filling:
    """`repeat` windows, each with counts[i] pieces of lengths[i], longest first."""

    lengths: tuple[int, ...]
    counts: tuple[int, ...]
    repeat: int


def closest_subset(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, within counts, whose sum comes closest to room without passing it."""
    reached, via, mask = 1, {}, (1 << (room + 1)) - 1
    goal = 1 << room
    for length in sorted((x for x in counts if x <= room and counts[x]), reverse=True):
        fresh = reached
        for _ in range(min(counts[length], room // length)):
            fresh = (fresh << length) & mask & ~reached
            if not fresh:
                break
            reached |= fresh
            bits = fresh
            while bits:
                low = bits & -bits
                via[low.bit_length() - 1] = length
                bits ^= low
        if reached & goal:
            break
    at, taken = reached.bit_length() - 1, {}
    while at:
        taken[via[at]] = taken.get(via[at], 0) + 1
        at -= via[at]
    return taken


def plan_fillings(counts: dict[int, int], capacity: int) -> list[Filling]:
    """Minimum bin slack over a histogram of lengths (each below capacity)."""
    left, out = {k: v for k, v in counts.items() if v > 0}, []
    while left:
        first = max(left)
        left[first] -= 1
        taken = closest_subset(left, capacity - first)
        left[first] += 1
        taken[first] = taken.get(first, 0) + 1
        repeat = min(left[k] // n for k, n in taken.items())
        for k, n in taken.items():
            left[k] -= n * repeat
            if not left[k]:
                del left[k]
        lengths = tuple(sorted(taken, reverse=True))
        out.append(Filling(lengths, tuple(taken[k] for k in lengths), repeat))
    return out


def slots(fillings: list[Filling], first_sequence: int) -> dict[int, tuple[list[int], list[tuple[int, int, int, int]]]]:
    """For each length, where its pieces go by rank: starting ranks, and (sequence, per window, offset, length)."""
    out: dict[int, tuple[list[int], list[tuple[int, int, int, int]]]] = {}
    used: dict[int, int] = {}
    sequence = first_sequence
    for f in fillings:
        offset = 0
        for length, n in zip(f.lengths, f.counts, strict=True):
            starts, rows = out.setdefault(length, ([], []))
            starts.append(used.get(length, 0))
            rows.append((sequence, n, offset, length))
            used[length] = used.get(length, 0) + n * f.repeat
            offset += n * length
        sequence += f.repeat
    return out


def _tokenize(path: str, end_id: int, capacity: int):
    def run(batches):
        enc, part = encoder(path), TaskContext.get().partitionId()
        rank, full_before = np.zeros(capacity, dtype=np.int64), 0
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            rows = []
            for i, doc_id in enumerate(ids):
                got = np.append(enc.ids(texts[i].as_py() or ""), np.array([end_id], dtype="<u4")).astype("<u4", copy=False)
                data = got.tobytes()
                crcs = [zlib.crc32(data[a : a + 4 * capacity]) for a in range(0, len(data), 4 * capacity)]
                full, rest = divmod(len(got), capacity)
                rows.append((doc_id, len(got), part, full_before, rest, int(rank[rest]), crcs))
                rank[rest] += rest > 0
                full_before += full
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            names = ["doc_id", "doc_tokens", "part", "full_before", "rest", "rest_rank", "crcs"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return run


def _place(where: dict, capacity: int):
    def run(batches):
        for batch in batches:
            out: list[list[int]] = [[] for _ in range(7)]
            for doc, total, before, rest, rank, crcs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for i, crc in enumerate(crcs):
                    if (i + 1) * capacity <= total:
                        row = (doc, i * capacity, capacity, crc, total, before + i, 0)
                    else:
                        starts, rows = where[rest]
                        k = bisect_right(starts, rank) - 1
                        sequence, n, offset, length = rows[k]
                        step, slot = divmod(rank - starts[k], n)
                        row = (doc, i * capacity, rest, crc, total, sequence + step, offset + slot * length)
                    for c, v in zip(out, row, strict=True):
                        c.append(v)
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names)

    return run


def pack(docs: DataFrame, *, capacity: int = 2048, end_id: int = 1, vocabulary: str | None = None) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone, so every row of docs has at least one piece. Rows that repeat,
    also with the same or a null doc_id, are packed one by one. Columns other than doc_id and text are not
    read, whatever their names. An empty table gives no rows. Very long texts are cut at whole windows.
    """
    path = vocabulary or default_vocabulary()
    tokens = saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_tokenize(path, end_id, capacity), TOKENIZED))
    cells = tokens.groupBy("part", "rest").agg(F.count("*").alias("n"), F.sum(F.floor(F.col("doc_tokens") / capacity)).alias("full"))
    # Bounded: one row for each length below capacity.
    lengths = cells.groupBy("rest").agg(F.sum("n").alias("n"), F.sum("full").alias("full")).collect()
    counts = {int(r["rest"]): int(r["n"]) for r in lengths if r["rest"]}
    where = slots(plan_fillings(counts, capacity), sum(int(r["full"]) for r in lengths))
    before = lambda n, window: F.coalesce(F.sum(n).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # The window without a key runs over one row for each input partition.
    starts = cells.groupBy("part").agg(F.sum("full").alias("full")).select("part", before("full", Window.orderBy("part")).alias("full_start"))
    bases = cells.withColumn("base", before("n", Window.partitionBy("rest").orderBy("part"))).join(starts, "part").select("part", "rest", "base", "full_start")
    ranked = tokens.join(bases, ["part", "rest"]).select("doc_id", "doc_tokens", (F.col("full_before") + F.col("full_start")).alias("full_before"), "rest", (F.col("rest_rank") + F.col("base")).alias("rest_rank"), "crcs")
    return ranked.mapInArrow(_place(where, capacity), PIECES)
