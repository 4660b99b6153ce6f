"""N-gram Jaccard join with prefix trees.

Every document is the set of its distinct shingles. One global order puts shingles by hash, those seen often at
the end, the most frequent last; two sets above the threshold must share one of their first few shingles (the
prefix bound), which gives the candidate blocks of near_sets. The sets of a block are stored in a trie, read from
the end of that order, so that what many documents share makes long common paths. Each set traverses the trie,
sharing partial overlaps of common paths; a subtree is left once overlap plus the lesser remaining length can't
reach the threshold, or once all of it is connected to the set already or ruled out by a parity sketch.
"""

from __future__ import annotations

import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.components import Forest
from corpusloom.llm.near_sets import ROWS, Cut, Threshold, candidates_within, digest, set_components, sketches
from corpusloom.llm.storage import saved

_U = np.uint64
#: Hashes below this share of their range are counted for the order; prefixes hardly reach beyond.
COUNTED = _U(1 << 62)


class Order:
    """The global order: rare shingles by hash, then common ones from the least to the most frequent.

    common: the frequent shingles of the corpus, sorted by hash; rank: their places by frequency, 0 the most frequent.
    """

    def __init__(self, common: np.ndarray, rank: np.ndarray):
        self.common, self.rank = common, rank

    def _often(self, elements: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.minimum(np.searchsorted(self.common, elements), len(self.common) - 1)
        return self.common[k] == elements, k

    def prefix(self, elements: np.ndarray, n: int) -> np.ndarray:
        """The first n of a set's sorted elements in the order."""
        if n >= len(elements) or not len(self.common):
            return elements[:n]
        often, k = self._often(elements)
        rare = elements[~often][:n]
        if len(rare) == n:
            return rare
        last = elements[often][np.argsort(-self.rank[k[often]])]
        return np.concatenate([rare, last[: n - len(rare)]])

    def from_the_end(self, values: np.ndarray) -> np.ndarray:
        """Places of sorted values in the order read backwards: the most frequent first."""
        place = np.empty(len(values), dtype=np.int64)
        if not len(self.common):
            place[::-1] = np.arange(len(values))
            return place
        often, k = self._often(values)
        place[np.lexsort((~values, np.where(often, self.rank[k], len(self.common))))] = np.arange(len(values))
        return place


def shared_order(common) -> Order:
    """The order from a broadcast of (hashes, ranks), of a fixed size at most."""
    return Order(np.frombuffer(common.value[0], dtype=_U), np.frombuffer(common.value[1], dtype=np.int64))


def _summaries(cut: Cut, least_count: int, most_held: int = 1 << 24):
    """ROWS of texts, and rows (token, seen) of shingles met least_count times among those that a task holds at once."""

    def run(batches):
        low, nodes = np.zeros(0, dtype=_U), set()
        names = ["doc_id", "ref", "line", "first_word", "n_words", "n", "node", "bits", "token", "seen"]

        def counted():
            token, seen = np.unique(low, return_counts=True)
            token, seen = token[seen >= least_count], seen[seen >= least_count]
            none, blank = pa.nulls(len(token), pa.int64()), pa.nulls(len(token), pa.binary())
            return pa.RecordBatch.from_arrays([none, none, pa.nulls(len(token), pa.int32()), none, none, none, blank, blank, pa.array(token.view(np.int64)), pa.array(seen, pa.int64())], names)

        for batch in batches:
            fresh, size, words, digests, sets = [], [], [], [], []
            for u in cut.units(batch.column(2)):
                node = digest(u.elements) if len(u.elements) else None
                size.append(len(u.elements))
                words.append(u.n_words)
                digests.append(node)
                sets.append(u.elements)
                if node is not None and node not in nodes:
                    nodes.add(node)
                    fresh.append(u.elements[: np.searchsorted(u.elements, COUNTED)])
            low = np.concatenate([low, *fresh])
            m, none = batch.num_rows, pa.nulls(batch.num_rows, pa.int64())
            zero = pa.array(np.zeros(m, dtype=np.int64))
            prints = [p if d is not None else None for p, d in zip(sketches(sets), digests, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), zero.cast(pa.int32()), zero, pa.array(words, pa.int64()), pa.array(size, pa.int64()), pa.array(digests, pa.binary()), pa.array(prints, pa.binary()), none, none], names)
            if len(low) > most_held or len(nodes) > most_held:  # counts of a part are enough for an order
                yield counted()
                low, nodes = low[:0], set()
        yield counted()

    return run


def _prefixes(limit: Threshold, common):
    """The prefix shingles of a set, the order's common ones coming from a broadcast of fixed size."""

    def tokens_of(elements: np.ndarray) -> np.ndarray:
        return shared_order(common).prefix(elements, limit.prefix(len(elements)))

    return tokens_of


def _linking(common):
    def link(sets: list[np.ndarray], limit: Threshold, sides: list[bool] | None = None) -> Forest:
        return link_within(sets, limit, sides, shared_order(common))

    return link


class Trie:
    """Sorted sequences as a tree of runs of elements; each subtree knows its leaves and their sizes."""

    __slots__ = ("run", "children", "leaves", "low", "high")

    def __init__(self, sequences: list[np.ndarray], rows: list[int], depth: int = 0):
        """rows: indices of sequences in lexical order, all alike up to depth."""
        first, last = sequences[rows[0]], sequences[rows[-1]]
        m = min(len(first), len(last))
        same = np.flatnonzero(first[depth:m] != last[depth:m])
        end = depth + int(same[0]) if len(same) else m
        self.run, self.leaves = first[depth:end], rows
        sizes = [len(sequences[r]) for r in rows]
        self.low, self.high = min(sizes), max(sizes)
        self.children = []
        inner = [r for r in rows if len(sequences[r]) > end]
        i = 0
        while len(rows) > 1 and i < len(inner):
            j, head = i + 1, sequences[inner[i]][end]
            while j < len(inner) and sequences[inner[j]][end] == head:
                j += 1
            self.children.append(Trie(sequences, inner[i:j], end))
            i = j


def link_within(sets: list[np.ndarray], limit: Threshold, sides: list[bool] | None = None, order: Order | None = None, seen: Counter | None = None) -> Forest:
    """Connects the indices of sets above the threshold; with sides, of sets on different sides only. seen counts the
    pairs that each step looks at: ordered pairs, those that sketches leave, those whose overlap the trie sums to its
    end, those linked."""
    forest = Forest()
    if len(sets) < 2:
        return forest
    every = np.concatenate(sets)
    values, ranks = np.unique(every, return_inverse=True)
    order = (order or Order(values[:0], np.zeros(0, dtype=np.int64))).from_the_end(values)
    seen = Counter() if seen is None else seen
    seen["pairs"] += len(sets) * (len(sets) - 1)
    cuts = np.cumsum([len(s) for s in sets])[:-1]
    seqs = [np.sort(s) for s in np.split(order[ranks], cuts)]
    rows = sorted(range(len(seqs)), key=lambda r: seqs[r].astype(">i8").tobytes())
    root = Trie(seqs, rows)
    maybe = candidates_within(sets, limit)
    for q in rows:
        hope = set(np.flatnonzero(maybe[q]).tolist()) - {q}
        hope = {r for r in hope if sides is None or sides[r] != sides[q]}
        seen["hoped"] += len(hope)
        mine, n = seqs[q], len(seqs[q])
        stack = [(root, 0, 0)]
        while stack:
            node, depth, overlap = stack.pop()
            if not limit.sizes_fit(min(n, node.high), max(n, node.low)) and (node.high < n or node.low > n):
                continue
            top = forest.find(q)
            open_here = hope if node is root else hope.intersection(node.leaves)
            if all(forest.find(r) == top for r in open_here):
                continue
            if len(node.run):
                at = np.searchsorted(mine, node.run)
                overlap += int((mine[np.minimum(at, n - 1)] == node.run).sum())
                depth += len(node.run)
                beyond = n - int(np.searchsorted(mine, node.run[-1], side="right"))
            else:
                beyond = n if depth == 0 else n - overlap
            if overlap + min(beyond, node.high - depth) < limit.overlap(n + node.low):
                continue
            stack += [(c, depth, overlap) for c in node.children]
            ended = node.leaves if not node.children else [r for r in node.leaves if len(seqs[r]) == depth]
            for r in ended:
                if r in hope:
                    seen["summed"] += 1
                    if overlap >= limit.overlap(n + len(seqs[r])):
                        seen["linked"] += 1
                        forest.join(q, r)
    return forest


def linked_nodes(texts: DataFrame, *, words: int, num: int, den: int, least_count: int, common_rows: int, chunk_sets: int, chunk_words: int) -> tuple[DataFrame, DataFrame]:
    """ROWS of each row of texts (doc_id, text), and (node, root) of each node linked to another."""
    cut, limit = Cut(words), Threshold(num, den)
    texts = texts.select("doc_id", F.xxhash64("text").alias("ref"), "text")
    both = saved(texts.mapInArrow(_summaries(cut, least_count), f"{ROWS}, token long, seen long"))
    rows = both.where("token IS NULL").drop("token", "seen")
    counted = both.where("token IS NOT NULL").groupBy("token").agg(F.sum("seen").alias("seen"))
    top = counted.orderBy(F.desc("seen"), "token").limit(common_rows).select("token").toArrow().column("token").to_numpy().astype(np.int64).view(_U)
    by_hash = np.argsort(top)  # top is in order of frequency: a hash's place in it is its rank
    common = texts.sparkSession.sparkContext.broadcast((top[by_hash].tobytes(), by_hash.astype(np.int64).tobytes()))
    return rows, set_components(texts, rows, cut, _prefixes(limit, common), limit, _linking(common), chunk_sets=chunk_sets, chunk_words=chunk_words)


def join_near(docs: DataFrame, *, words: int = 4, num: int = 85, den: int = 100, least_count: int = 3, common_rows: int = 1 << 18, chunk_sets: int = 256, chunk_words: int = 1 << 20) -> DataFrame:
    """doc_id, n_shingles, component_id: one row for each row of docs.

    Null and empty texts, and texts of white space alone, have no shingles and are linked with nothing; their
    component is their own id. Repeated rows are equal sets and so linked; among rows with and without an id
    the smallest id names the component, null only where no row of it has one. Whole texts are read, other
    columns are not. An empty table gives no rows.

    least_count and common_rows shape the global order and so the cost, never the result; chunk_sets and
    chunk_words bound a group of sets that meet in one task.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows, linked = linked_nodes(texts, words=words, num=num, den=den, least_count=least_count, common_rows=common_rows, chunk_sets=chunk_sets, chunk_words=chunk_words)
    smallest = rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    named = smallest.join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    per_root = named.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("copies").alias("all")).where("all > 1")
    names = saved(named.join(per_root, "root").select(F.col("node").alias("of"), "component_id"))
    out = rows.join(names, rows.node == names.of, "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """docs with one row of each group of near copies: that of the smallest id. All columns stay.

    Rows without shingles or without an id stay. Of rows that repeat an id and its text one stays; rows that
    share an id but not the text stay or go together.
    """
    found = saved(join_near(docs, **how))
    gone = found.where(F.col("component_id") < F.col("doc_id")).select(F.col("doc_id").alias("gone_id")).distinct()
    kept = docs.join(gone, docs["doc_id"].cast("long") == gone["gone_id"], "left_anti")
    if found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        return kept
    among, copy = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("doc_id"), f"copy {uuid.uuid4().hex}"
    return kept.withColumn(copy, F.row_number().over(among)).where(F.col("doc_id").isNull() | (F.col(copy) == 1)).drop(copy)
