"""Benchmark decontamination by SimHash over item-sized windows.

Every window of a document that has an item's number of words is a candidate. A window whose weighted five-word
shingles reach the least similarity has at least that share of its weight in shingles made of the benchmark's
words alone, so windows that don't are passed over by one subtraction of running sums; all others get a 128-bit
SimHash from rolling sums of signs. A multi-index over blocks of 11 and 12 bits finds the items: its tables list,
for each value of a block, the items within so many flipped bits, and as those numbers plus one add up to more
than the radius, every fingerprint within the radius is listed by some block. Exact weighted similarity decides
on what the index gives. The benchmark is dealt in blocks of a bounded size, each matched against all documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.textkit import _PLACE, mix, spans, word_hashes

_U = np.uint64
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SHINGLE = 5
BITS = 128
#: Widths of the index's blocks, which add up to BITS.
WIDTHS = (12, 12, 12, 12, 12, 12, 12, 11, 11, 11, 11)
SCHEMA = "doc_id long, item_id long, first_word long, n_words long, hamming int, similarity double"
_SALTS = mix(np.arange(71, 73, dtype=_U))
#: Windows that are fingerprinted at once start within so many words.
STRETCH = 1 << 16


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def shingles(words: list[str]) -> list[str]:
    """Five consecutive words each; of fewer words, the whole sequence as one."""
    if len(words) < SHINGLE:
        return [" ".join(words)] if words else []
    return list(map(" ".join, zip(*(words[k:] for k in range(SHINGLE)), strict=False)))


def weight(shingle: str) -> float:
    """A shingle that repeats its words says less."""
    words = shingle.split(" ")
    return len(set(words)) / len(words)


def similarity(a: list[str], b: list[str]) -> float:
    """Weighted Jaccard of two multisets of shingles."""
    left: dict[str, list[int]] = {}
    for k, parts in enumerate((a, b)):
        for p in parts:
            left.setdefault(p, [0, 0])[k] += 1
    low = high = 0.0
    for p, (x, y) in left.items():
        w = weight(p)
        low, high = low + w * min(x, y), high + w * max(x, y)
    return low / high if high else 0.0


def hashed_words(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, hashes of words, number of each text's first word) of runs of texts."""
    low = pa.array([t.lower() if t else "" for t in texts], pa.large_string())
    for row, data, bounds in spans(low):
        yield row, *word_hashes(data, bounds, terms=True)


def hashed_shingles(words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number of distinct words) of k consecutive words each, over text bounds too."""
    m = max(0, len(words) - k + 1)
    runs = [words[i : i + m] for i in range(k)]
    value, distinct = np.zeros(m, dtype=_U), np.ones(m, dtype=np.int32)
    for i in range(k):
        value += runs[i] * _PLACE[i]
        if i:
            fresh = runs[i] != runs[0]
            for j in range(1, i):
                fresh &= runs[i] != runs[j]
            distinct += fresh
    return mix(value + _U(k)), distinct


def bits_of(hashes: np.ndarray) -> np.ndarray:
    """The 128 bits of each shingle, as two words."""
    return np.stack([mix(hashes ^ s) for s in _SALTS], axis=1)


def rolling_signs(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Running sums, from zero on, of the weighted signs of each shingle's bits."""
    signs = np.unpackbits(bits_of(hashes).view(np.uint8), axis=1).astype(np.int32) * 2 - 1
    sums = np.zeros((len(hashes) + 1, BITS), dtype=np.int32)
    np.cumsum(signs * weights[:, None], axis=0, out=sums[1:])
    return sums


def fingerprints(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """SimHash, as two words, of each run [start, end) of shingles."""
    return np.packbits(sums[ends] > sums[starts], axis=1).view(_U)


def blocks_of_bits(prints: np.ndarray) -> list[np.ndarray]:
    """The values of each block of fingerprints."""
    out, at = [], 0
    for width in WIDTHS:
        word, place = divmod(at, 64)
        value = prints[:, word] >> _U(place)
        if place + width > 64:
            value = value | prints[:, word + 1] << _U(64 - place)
        out.append((value & _U((1 << width) - 1)).astype(np.int64))
        at += width
    return out


def flips(radius: int) -> list[int]:
    """How many bits may differ in each block: as few as it takes for the numbers plus one to pass the radius, the
    wider blocks first. Fingerprints that differ more in every block differ in more than radius bits."""
    n = len(WIDTHS)
    least, more = divmod(radius + 1 - n, n) if radius + 1 >= n else (-1, radius + 1)
    return [least + (b < more) for b in range(n)]


class BlockIndex:
    """All fingerprints within the radius. tables[b][value] holds, as bits, the items whose block b is near value."""

    def __init__(self, prints: np.ndarray, radius: int):
        self.prints, self.radius = prints, radius
        self.tables = []
        for width, near, own in zip(WIDTHS, flips(radius), blocks_of_bits(prints), strict=True):
            close = np.bitwise_count(np.arange(1 << width)[:, None] ^ own[None, :]) <= near
            self.tables.append(np.packbits(close, axis=1, bitorder="little"))

    def candidates(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, item) of the pairs that some block lists."""
        held = None
        for table, values in zip(self.tables, blocks_of_bits(queries), strict=True):
            held = table[values] if held is None else held | table[values]
        return np.nonzero(np.unpackbits(held, axis=1, bitorder="little")[:, : len(self.prints)])

    def within(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, item, distance) of every pair within the radius."""
        q, i = self.candidates(queries)
        d = np.bitwise_count(queries[q] ^ self.prints[i]).sum(axis=1, dtype=np.int64)
        keep = d <= self.radius
        return q[keep], i[keep], d[keep]


class Benchmark:
    """One block of items, ready to be matched; seen counts what each step looks at."""

    def __init__(self, rows: list[tuple[int, str]], radius: int, least: float):
        self.items = [(i, w) for i, w in sorted({(i, tuple(words_of(t))) for i, t in rows}, key=lambda x: (x[1], x[0] is not None, x[0] or 0)) if w]
        self.parts = [shingles(list(w)) for _, w in self.items]
        self.least, self.seen = least, Counter()
        hashes = [w for _, words, at in hashed_words([" ".join(w) for _, w in self.items]) for w in np.split(words, at[1:-1])]
        self.known = np.zeros(1 << 20, dtype=bool)  # a word outside the benchmark may pass by chance, none within fails
        by_size: dict[int, list[int]] = {}
        for k, h in enumerate(hashes):
            self.known[(h & _U(len(self.known) - 1)).astype(np.int64)] = True
            by_size.setdefault(len(h), []).append(k)
        self.by_size = {n: (np.array(ks), BlockIndex(np.concatenate([self._print(hashes[k]) for k in ks]), radius)) for n, ks in sorted(by_size.items())}

    @staticmethod
    def _print(words: np.ndarray) -> np.ndarray:
        value, distinct = hashed_shingles(words, min(SHINGLE, len(words)))
        return fingerprints(rolling_signs(value, distinct), np.array([0]), np.array([len(value)]))

    def windows(self, words: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(size, starts, fingerprints) of the windows of each item's size that may reach the least similarity. A
        text of fewer words than an item is one window as a whole."""
        length = np.diff(at)
        left = np.repeat(at[1:], length) - np.arange(len(words))
        known = self.known[(words & _U(len(self.known) - 1)).astype(np.int64)]
        value, distinct = hashed_shingles(words, SHINGLE)
        m = len(value)
        whole = known[:m].copy()
        for k in range(1, SHINGLE):
            whole &= known[k : k + m]
        balance = np.concatenate([[0.0], np.cumsum((whole - self.least) * distinct)])
        opened: list[tuple[int, np.ndarray, np.ndarray]] = []
        for n in self.by_size:
            self.seen["windows"] += int((left >= n).sum()) + int((length < n).sum())
            if n < SHINGLE:
                own, _ = hashed_shingles(words, n)
                fit = left[: len(own)] >= n
                for k in range(n):
                    fit &= known[k : k + len(own)]
                starts = np.flatnonzero(fit)
                self.seen["fingerprints"] += len(starts)
                if len(starts):
                    yield n, starts, bits_of(own[starts])
                continue
            reach = n - SHINGLE + 1
            size = max(0, m - reach + 1)
            starts = np.flatnonzero((balance[reach:] - balance[:size] >= -1e-9) & (left[:size] >= n))
            short = np.flatnonzero((length >= SHINGLE) & (length < n))
            short = short[balance[at[short + 1] - SHINGLE + 1] - balance[at[short]] >= -1e-9]
            starts, ends = np.append(starts, at[short]), np.append(starts + reach, at[short + 1] - SHINGLE + 1)
            if len(starts):
                order = np.argsort(starts, kind="stable")
                opened.append((n, starts[order], ends[order]))
                self.seen["fingerprints"] += len(starts)
        # Signs are summed once for all sizes, and only where some window lies.
        for low in range(0, m, STRETCH):
            parts = []
            for n, starts, ends in opened:
                i, j = np.searchsorted(starts, (low, low + STRETCH))
                if i < j:
                    parts.append((n, starts[i:j], ends[i:j]))
            if not parts:
                continue
            high = max(int(ends.max()) for _, _, ends in parts)
            edge = np.zeros(high - low + 1, dtype=np.int64)
            for _, starts, ends in parts:
                np.add.at(edge, starts - low, 1)
                np.add.at(edge, ends - low, -1)
            covered = np.cumsum(edge)[:-1] > 0
            place = np.concatenate([[0], np.cumsum(covered)])
            held = low + np.flatnonzero(covered)
            sums = rolling_signs(value[held], distinct[held])
            for n, starts, ends in parts:
                yield n, starts, fingerprints(sums, place[starts - low], place[ends - low])

    def match(self, texts: list[str | None]) -> list[list[tuple[int, int, int, int, float]]]:
        """For each text its (item id, first word, words, distance, similarity): the best window for each item, the
        earliest of equals."""
        out: list[list] = [[] for _ in texts]
        if not self.items:
            return out
        for row, words, at in hashed_words(texts):
            best: dict[tuple, tuple] = {}
            spelled: dict[int, list[str]] = {}
            for n, starts, prints in self.windows(words, at):
                ks, index = self.by_size[n]
                for q, i, d in zip(*(v.tolist() for v in index.within(prints)), strict=True):
                    self.seen["compared"] += 1
                    s, k = int(starts[q]), int(ks[i])
                    text = int(np.searchsorted(at, s, side="right")) - 1
                    if text not in spelled:
                        spelled[text] = words_of(texts[row + text])
                    s -= int(at[text])
                    window, item = spelled[text][s : s + n], self.items[k][0]
                    value = similarity(shingles(window), self.parts[k])
                    held = best.get((text, item))
                    if value >= self.least and (held is None or (-value, s) < (-held[4], held[1])):
                        best[text, item] = (item, s, len(window), d, value)
            for (text, _), found in best.items():
                out[row + text].append(found)
        return [sorted(x, key=lambda f: (f[0] is not None, f[0] or 0)) for x in out]


def blocks_of(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about block_chars characters at most; each block alone reaches the driver."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(F.length("text") > 0)
    n = max(1, -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars))
    for b in range(n):
        mine = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        yield [(r["item_id"], r["text"]) for r in mine.collect()]


def _run(shared, radius: int, least: float):
    def run(batches):
        bench = Benchmark(shared.value, radius, least)
        for batch in batches:
            ids, found = batch.column(0).to_pylist(), bench.match(batch.column(1).to_pylist())
            rows = [(doc_id, *m) for doc_id, ms in zip(ids, found, strict=True) for m in ms]
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64()] * 4 + [pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "item_id", "first_word", "n_words", "hamming", "similarity"])

    return run


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, least: float = 0.8, radius: int = 40, block_chars: int = 2_000_000) -> DataFrame:
    """doc_id, item_id, first_word, n_words, hamming, similarity: a row for each document row and item found in it.

    Null and empty texts, of documents and of items, match nothing. Rows that repeat are matched one by one
    (an item that repeats with the same id counts once). Among equally similar windows the earliest is given.
    Whole texts are read; columns other than doc_id, item_id and text are not. Empty tables give no rows.
    A similarity of 0.8 turns 19 of the 128 bits, give or take four; a radius of 40 lies five deviations above.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = None
    for block in blocks_of(benchmark, block_chars):
        one = rows.mapInArrow(_run(docs.sparkSession.sparkContext.broadcast(block), radius, least), SCHEMA)
        found = one if found is None else found.unionByName(one)
    return found


def _clean(shared, radius: int, least: float, column: int):
    def run(batches):
        bench = Benchmark(shared.value, radius, least)
        for batch in batches:
            found = bench.match(batch.column(column).to_pylist())
            yield batch.filter(pa.array([not f for f in found], pa.bool_()))

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, least: float = 0.8, radius: int = 40, block_chars: int = 2_000_000) -> DataFrame:
    """docs without the rows in which find_contamination finds an item; all columns stay, whatever their names."""
    docs = docs.withColumn("text", F.col("text").cast("string"))
    for block in blocks_of(benchmark, block_chars):
        docs = docs.mapInArrow(_clean(docs.sparkSession.sparkContext.broadcast(block), radius, least, docs.columns.index("text")), docs.schema)
    return docs
