"""Units of a document laid along the blocks of its source."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from itertools import accumulate, pairwise

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What parts the blocks of a source, and what a comparison leaves out (formulas, images, marks).
BLOCKS = r"\n{2,}|\n(?=\s*(?:\d{1,3}[.)]|\(\d{1,3}\)|[가-힣][.)]|\([가-힣]\)|[a-z][.)]|\([a-z]\)|[-●•▪])\s)"
FORMULA, IMAGE, MARKS = re.compile(r"\$\$.*?\$\$|\$[^$\n]*\$", re.S), re.compile(r"!\[.*?\]\([^)]*\)"), re.compile(r"[#*_>`|●•▪◦·–—]")
#: Beginnings by which a unit is looked for when it isn't found whole: from the cursor on, then anywhere; units of fewer
#: than SHORT characters only by SHORTEST to LAST of their first characters.
NEAR, FAR, SHORT, LAST, SHORTEST = 36, 24, 8, 20, 5
#: Words of a run that anchors a unit, if it stands once in the units and once in the blocks.
RARE = 5
PLACED = "unit_id string, first_block int, last_block int, how string"


def comparable(text: str) -> str:
    return " ".join(MARKS.sub(" ", IMAGE.sub("", FORMULA.sub("", text))).lower().split())


def source_blocks(text: str) -> list[str]:
    return [b.strip() for b in re.split(BLOCKS, text) if b.strip()]


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest chain of pairs, sorted by the first, whose seconds rise."""
    if all(x[1] < y[1] for x, y in pairwise(pairs)):
        return pairs
    tails, at, back = [], [], []
    for k, (_, y) in enumerate(pairs):
        n = bisect_left(tails, y)
        if n == len(tails):
            tails.append(y)
            at.append(k)
        tails[n], at[n] = y, k
        back.append(at[n - 1] if n else -1)
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def _runs(text: str) -> list[tuple[str, int]]:
    """Runs of RARE words of a text with single blanks, and where each begins."""
    past = list(accumulate(len(w) + 1 for w in text.split(" ")))
    return [(text[a : b - 1], a) for a, b in zip([0, *past], past[RARE - 1 :], strict=False)]


def anchors(units: list[str], whole: str) -> list[tuple[int, int]]:
    """(unit, place in whole) that rise together: by runs of words that stand once in the units and once in the whole."""
    of_unit = [(run, u) for u, text in enumerate(units) for run, _ in _runs(text)]
    held = _runs(whole)
    once, here = Counter([run for run, _ in of_unit]), Counter([run for run, _ in held])
    place = {run: at for run, at in held if here[run] == 1}
    return rising([(u, place[run]) for run, u in of_unit if once[run] == 1 and run in place])


def place_units(units: list[str], blocks: list[str]) -> list[tuple[int, int, str] | None]:
    """The first and the last block of each unit, and how it was found: None for a unit that stands in none.

    Units and blocks come in the order of one source, so a cursor moves along the blocks. A chain of anchors says
    between which places a unit should begin; it is looked for there first, whole ("whole") and by its beginning
    ("begins"), then after the cursor, then anywhere ("moved"); what was found out of place doesn't move the cursor.
    """
    texts, starts, numbers, at = [], [], [], 0
    for number, block in enumerate(blocks):
        if plain := comparable(block):
            texts.append(plain)
            starts.append(at)
            numbers.append(number)
            at += len(plain) + 1
    whole, plains = " ".join(texts), [comparable(u) for u in units]
    fixed = anchors(plains, whole)
    least, most = {}, {}
    for u, p in fixed:
        least.setdefault(u, p)
        most[u] = p
    ahead, known = len(whole), []  # where the next anchored unit begins at the latest
    for u in range(len(plains) - 1, -1, -1):
        known.append(ahead)
        ahead = least.get(u, ahead)
    known.reverse()
    block = lambda c: numbers[max(0, bisect_right(starts, c) - 1)]
    out, cursor = [], 0
    for u, plain in enumerate(plains):
        if not plain or not numbers:
            out.append(None)
            continue
        bound = max(known[u], most.get(u, 0)) + len(plain)
        tries = [(plain, cursor, bound, "whole"), (plain, cursor, None, "whole")]
        if len(plain) >= SHORT:
            tries += [(plain[:NEAR], cursor, bound, "begins"), (plain[:NEAR], cursor, None, "begins"), (plain[:FAR], 0, None, "moved")]
        tries.append((plain[: max(SHORTEST, min(LAST, len(plain)))], 0, None, "moved"))
        for text, start, end, how in tries:
            if (p := whole.find(text, start, end)) >= 0:
                last = min(p + len(plain), len(whole))
                astray = how != "moved" and u not in least and p > known[u]
                out.append((block(p), block(max(p, last - 1)), "moved" if astray else how))
                if how != "moved" and not astray:
                    cursor = last
                break
        else:
            out.append(None)
    return out


def align_units(units: DataFrame, sources: DataFrame, by: str = "doc_id", unit: str = "unit_id", order: str = "ord", text: str = "text", source: str = "text") -> DataFrame:
    """(by, unit_id, first_block, last_block, how) for the units (by, unit, order, text) of each source (by, source);
    blocks are numbered from 0. What isn't found, and units without a source, have nulls. Documents are placed one by one."""
    kind = units.schema[by].dataType.simpleString()

    def run(batches):
        for rows in batches:
            out = []
            for k, ids, texts, said in zip(rows["k"], rows["i"], rows["t"], rows["s"], strict=True):
                out += [(k, i, *(p or (None, None, None))) for i, p in zip(ids, place_units([t or "" for t in texts], source_blocks(said or "")), strict=True)]
            yield pd.DataFrame(out, columns=["k", "unit_id", "first_block", "last_block", "how"]).astype({"first_block": "Int32", "last_block": "Int32"})

    parts = F.struct(F.col(order).isNull(), F.col(order), F.col(unit).cast("string").alias("i"), F.col(text).alias("t"))
    left = units.groupBy(F.col(by).alias("k")).agg(F.array_sort(F.collect_list(parts)).alias("u"))
    right = sources.groupBy(F.col(by).alias("k of source")).agg(F.array_join(F.filter(F.collect_list(source), lambda x: x != ""), "\n\n").alias("s"))
    both = left.join(right, F.col("k").eqNullSafe(F.col("k of source")), "left").select("k", F.transform("u", lambda x: x["i"]).alias("i"), F.transform("u", lambda x: x["t"]).alias("t"), "s")
    return both.mapInPandas(run, f"k {kind}, {PLACED}").withColumnRenamed("k", by)
