"""Sets of shingles above a Jaccard threshold: what the n-gram join and the paragraph join have in common.

Texts are cut into units (whole texts or paragraphs), a unit is the set of its distinct shingles, and equal
sets are one node with a parity sketch. The sketches of two sets differ in no more bits than the sets differ in
elements, so what a pair of sketches rules out is below the threshold for certain.

Tokens of each node (prefix shingles, or band keys) list the nodes that hold them. Sketches leave, of each
list, the pairs that may link; components of these are blocks that no link leaves. The texts of the blocks'
nodes, and of no others, are gathered by block, packed, and each block's sets are linked exactly. A long list,
and a large block, is dealt in chunks, and each chunk meets a hub chunk; only what is apart after that meets
across all chunks, and pairs left between different components are linked. So a family of near copies costs a
multiple of its size, not its square. No group holds more than two chunks, connected pairs are never emitted,
and every pair above the threshold is either found or connected. Tokens that a sample shows to be very common
are dealt by node instead of by token: their rows go straight into a long list.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.components import Forest, components
from corpusloom.llm.storage import saved
from corpusloom.llm.textkit import mix, shingle_sets

_U = np.uint64
ROWS = "doc_id long, ref long, line int, first_word long, n_words long, n long, node binary, bits binary"
#: Odd, so that lines of one text fall apart in the filter for texts.
STEP = 1_000_003


class Threshold:
    """Jaccard of at least num / den, in whole numbers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def overlap(self, n: int) -> int:
        """The least overlap of two sets whose sizes sum to n."""
        return -(-self.num * n // (self.num + self.den))

    def prefix(self, n: int) -> int:
        """How many of a set's first elements must hold one of any set above the threshold."""
        return n - -(-self.num * n // self.den) + 1 if n else 0

    def stands_alone(self, n: int) -> bool:
        """Whether no other set is within the threshold of a set of n: n of n + 1 is the nearest that one can be."""
        return n * self.den < self.num * (n + 1)

    def sizes_fit(self, small, large):
        return small * self.den >= large * self.num


class Unit(NamedTuple):
    row: int
    line: int
    first_word: int
    n_words: int
    elements: np.ndarray
    text: pa.Scalar


class Cut:
    """How texts become units: whole, or by lines of at least least_words words; words: the size of a shingle."""

    def __init__(self, words: int, by_lines: bool = False, least_words: int = 0):
        self.words, self.by_lines, self.least_words = words, by_lines, least_words

    def places(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """(text of each unit, its row, its line): every line, or every text."""
        if not self.by_lines:
            return texts, np.arange(len(texts)), np.zeros(len(texts), dtype=np.int64)
        lines = pc.split_pattern(texts.fill_null(""), "\n")
        rows = pc.list_parent_indices(lines).to_numpy()
        return lines.flatten(), rows, np.arange(len(rows)) - np.searchsorted(rows, rows)

    def units(self, texts: pa.Array) -> Iterator[Unit]:
        flat, rows, lines = self.places(texts)
        row, at = -1, 0
        for k, (here, line, (n, elements)) in enumerate(zip(rows.tolist(), lines.tolist(), shingle_sets(flat, self.words, self.least_words), strict=True)):
            if here != row:
                row, at = here, 0
            if not self.by_lines or n >= max(1, self.least_words):
                yield Unit(row, line, at, n, elements, flat[k])
            at += n

    def elements(self, text: bytes) -> np.ndarray:
        return next(shingle_sets(pa.array([text.decode("utf-8")], pa.string()), self.words))[1]


Tokens = Callable[[np.ndarray], np.ndarray]
Link = Callable[[list[np.ndarray], Threshold, list[bool] | None], Forest]


def sketch(elements: np.ndarray, bits: int) -> np.ndarray:
    """For each hash modulo bits (a power of two), whether an odd number of elements have it."""
    odd = np.bincount((elements & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def sketches(sets: list[np.ndarray]) -> list[bytes]:
    """The sketch of each set, each as wide as it needs, worked out for all sets of a width at once."""
    out: list[bytes] = [b""] * len(sets)
    by_width: dict[int, list[int]] = {}
    for k, s in enumerate(sets):
        by_width.setdefault(sketch_bits(len(s)), []).append(k)
    for bits, ks in by_width.items():
        for i in range(0, len(ks), max(1, (1 << 22) // bits)):
            part = ks[i : i + max(1, (1 << 22) // bits)]
            sizes = [len(sets[k]) for k in part]
            at = np.repeat(np.arange(len(part)) * bits, sizes) + (np.concatenate([sets[k] for k in part]) & _U(bits - 1)).astype(np.int64)
            odd = np.bincount(at, minlength=len(part) * bits) & 1
            raw = np.packbits(odd.astype(np.uint8)).tobytes()
            for j, k in enumerate(part):
                out[k] = raw[j * bits // 8 : (j + 1) * bits // 8]
    return out


def sketch_bits(n: int) -> int:
    """Twice as many bits as elements or more, so that sets just below the threshold mostly show it; 64 to 16384."""
    return min(1 << 14, max(64, 1 << (2 * n - 1).bit_length()))


def may_link(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, limit: Threshold) -> np.ndarray:
    """Which pairs of sketches (of one width) don't rule out the threshold; False is certain. Worked in strips."""
    out = np.zeros((len(a), len(b)), dtype=bool)
    for s in range(0, len(a), 128):
        x, n = a[s : s + 128], na[s : s + 128]
        total = n[:, None] + nb[None, :]
        least = -(-limit.num * total // (limit.num + limit.den))
        differ = np.zeros(total.shape, dtype=np.int32)
        for k in range(a.shape[1]):
            differ += np.bitwise_count(x[:, k][:, None] ^ b[:, k][None, :])
        out[s : s + 128] = (differ <= total - 2 * least) & (np.minimum(n[:, None], nb[None, :]) >= least)
    return out


def pair_may_link(a: bytes, na: int, b: bytes, nb: int, limit: Threshold) -> bool:
    """The same for two sketches of any widths."""
    least = limit.overlap(na + nb)
    if min(na, nb) < least:
        return False
    width = min(len(a), len(b)) * 8
    x, y = (_folded(v, width) for v in (a, b))
    return (x ^ y).bit_count() <= na + nb - 2 * least


def _folded(raw: bytes, width: int) -> int:
    n, bits = int.from_bytes(raw, "little"), len(raw) * 8
    while bits > width:
        bits //= 2
        n = (n >> bits) ^ (n & ((1 << bits) - 1))
    return n


def narrowed(bitmap: np.ndarray, words: int) -> np.ndarray:
    """The sketch for a smaller power of two of bits: halves laid over each other."""
    while len(bitmap) > words:
        bitmap = bitmap.reshape(2, -1)[0] ^ bitmap.reshape(2, -1)[1]
    return bitmap


def candidates_within(sets: list[np.ndarray], limit: Threshold) -> np.ndarray:
    """A square of which sets may link, by sketches wide enough for the largest."""
    bits = sketch_bits(max(map(len, sets)))
    prints, n = np.stack([sketch(s, bits) for s in sets]), np.array([len(s) for s in sets])
    return may_link(prints, n, prints, n, limit)


def digest(elements: np.ndarray) -> bytes:
    return hashlib.blake2b(elements.tobytes(), digest_size=16).digest()


def short_id(node: bytes) -> int:
    return int.from_bytes(node[:8], "big", signed=True)


def _postings(cut: Cut, tokens_of: Tokens):
    def run(batches):
        nodes = set()
        for batch in batches:
            tokens, ids = [], []
            for u in cut.units(batch.column(0)):
                if not len(u.elements) or (node := digest(u.elements)) in nodes:
                    continue
                nodes.add(node)
                p = tokens_of(u.elements)
                tokens.append(p)
                ids.append(np.full(len(p), short_id(node), dtype=np.int64))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(ids))], ["token", "nid"])

    return run


def _lists(longest: int):
    """Rows in order of token: (list, nid) for each list of two nodes or more, equal lists of a task once.

    At most `longest` rows of a token are held; a longer list goes out as it comes, under its token, and so do the
    rows of a token that is dealt by node (those with a salt).
    """

    def packed(lists, nids):
        return pa.RecordBatch.from_arrays([pa.array(lists), pa.array(nids)], ["list", "nid"])

    def groups(token, nid, seen):
        cut = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        size = np.diff(np.append(cut, len(token)))
        two = cut[size == 2]
        pairs = np.sort(np.stack([nid[two], nid[two + 1]], axis=1), axis=1)
        pairs = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)
        names = mix(mix(pairs[:, 0].view(_U)) + pairs[:, 1].view(_U)).view(np.int64)
        out = [(names.repeat(2), pairs.reshape(-1))]
        for a, m in zip(cut[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            members = np.unique(nid[a : a + m])
            name = int.from_bytes(hashlib.blake2b(members.tobytes(), digest_size=8).digest(), "big", signed=True)
            if len(members) > 1 and name not in seen:
                seen.add(name)
                out.append((np.full(len(members), name), members))
        return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])

    def run(batches):
        seen, long = set(), None
        held = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for batch in batches:
            token, nid, salt = (c.to_numpy() for c in batch.columns)
            if (salt >= 0).any():
                yield packed(token[salt >= 0], nid[salt >= 0])
                token, nid = token[salt < 0], nid[salt < 0]
            token, nid = np.append(held[0], token), np.append(held[1], nid)
            if long is not None:
                more = int(np.searchsorted(token != long, True))
                if more:
                    yield packed(token[:more], nid[:more])
                token, nid = token[more:], nid[more:]
                long = long if not len(token) else None
            if not len(token):
                held = token, nid
                continue
            last = int(np.searchsorted(token, token[-1]))
            if last:
                yield packed(*groups(token[:last], nid[:last], seen))
            held = token[last:], nid[last:]
            if len(held[0]) > longest:
                yield packed(*held)
                long = int(held[0][0])
                held = held[0][:0], held[1][:0]
        if len(held[0]):
            yield packed(*groups(*held, seen))

    return run


def possible_links(left: list[bytes], n_left: list[int], right: list[bytes], n_right: list[int], limit: Threshold) -> np.ndarray:
    """Which pairs of sketches of any widths don't rule out the threshold."""
    by = []
    for prints in (left, right):
        widths: dict[int, list[int]] = {}
        for k, p in enumerate(prints):
            widths.setdefault(len(p) // 8, []).append(k)
        by.append({w: np.array(ks) for w, ks in widths.items()})
    sizes = np.array(n_left), np.array(n_right)
    out = np.zeros((len(left), len(right)), dtype=bool)
    for w, x in by[0].items():
        for v, y in by[1].items():
            both = min(w, v)
            a = np.stack([narrowed(np.frombuffer(left[k], dtype=_U), both) for k in x])
            b = np.stack([narrowed(np.frombuffer(right[k], dtype=_U), both) for k in y])
            out[np.ix_(x, y)] = may_link(a, sizes[0][x], b, sizes[1][y], limit)
    return out


def reached(square: np.ndarray) -> list[tuple[int, int]]:
    """(index, first index) of each index that the links of a symmetric square connect to an earlier one."""
    open_, out = np.ones(len(square), dtype=bool), []
    for s in range(len(square)):
        if open_[s]:
            open_[s] = False
            edge = np.array([s])
            while len(edge):
                fresh = square[edge].any(axis=0) & open_
                open_ &= ~fresh
                edge = np.flatnonzero(fresh)
                out += [(k, s) for k in edge.tolist()]
    return out


def stars(nodes: list, links: list[tuple[int, int]]) -> list[tuple]:
    """Links (index, index of the centre) as edges from each node to the least that hangs on its centre."""
    least: dict = {}
    for k, s in links:
        least[s] = min(least.get(s, nodes[s]), nodes[k])
    edges = dict.fromkeys([(nodes[k], least[s]) for k, s in links] + [(nodes[s], node) for s, node in least.items()])
    return [(a, b) for a, b in edges if a != b]


def _possible(limit: Threshold):
    """Groups in a row by (list, i, j): stars of the nodes that sketches leave linked."""

    def close(rows):
        nodes, sizes, prints = map(list, zip(*rows, strict=True))
        if len(rows) > 4:
            return stars(nodes, reached(possible_links(prints, sizes, prints, sizes, limit)))
        return [(nodes[k], nodes[s]) for k in range(len(rows)) for s in range(k) if nodes[k] != nodes[s] and pair_may_link(prints[k], sizes[k], prints[s], sizes[s], limit)]

    def run(batches):
        key, rows, out = None, [], []
        for batch in batches:
            for name, i, j, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (name, i, j) != key:
                    out += close(rows) if len(rows) > 1 else []
                    key, rows = (name, i, j), []
                rows.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])
                out = []
        if len(rows) > 1 and (out := close(rows)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])

    return run


def _bridges(limit: Threshold):
    """Groups in a row by (list, i, j): links between different roots that sketches leave, as few as connect them."""

    def close(rows):
        sides = ([], [])
        for row in rows:
            sides[row[1]].append(row)
        others, queries = sides
        if not others or not queries:
            return []
        may = possible_links([q[4] for q in queries], [q[3] for q in queries], [o[4] for o in others], [o[3] for o in others], limit)
        left, right, forest = np.array([q[2] for q in queries]), np.array([o[2] for o in others]), Forest()
        pairs = np.argwhere(may & (left[:, None] != right[None, :]))
        return [(a, b) for a, b in {(int(left[i]), int(right[j])) for i, j in pairs.tolist()} if forest.join(a, b)]

    def run(batches):
        key, rows, out = None, [], []
        for batch in batches:
            for name, i, j, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (name, i, j) != key:
                    out += close(rows)
                    key, rows = (name, i, j), []
                rows.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])
                out = []
        if out := close(rows):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])

    return run


def _members(cut: Cut, bitmap, bits: int):
    """Texts (ref, text) with a unit whose place stands in the bitmap: the place and the unit's text, packed. No word
    is read. A few units pass by chance; the join drops these."""

    def run(batches):
        held, seen, pack = np.frombuffer(bitmap.value, dtype=np.uint8), set(), zstandard.ZstdCompressor(level=3)
        for batch in batches:
            flat, rows, lines = cut.places(batch.column(1))
            refs = batch.column(0).to_numpy()[rows]
            at = (refs ^ (lines * STEP)) & ((1 << bits) - 1)
            out = []
            for k in np.flatnonzero(held[at >> 3] >> (at & 7) & 1).tolist():
                text = (flat[k].as_py() or "").encode()
                if (place := (int(refs[k]), int(lines[k]), len(text))) not in seen:
                    seen.add(place)
                    out.append((*place[:2], pack.compress(text)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], ["ref", "line", "packed"])

    return run


def _linked(cut: Cut, limit: Threshold, link: Link, crossing: bool):
    """Groups in a row by (block, i, j): stars of what is linked in each. crossing: only one side against the other."""

    def close(rows):
        seen, sets, nodes, sides, unpack = set(), [], [], [], zstandard.ZstdDecompressor()
        for node, packed, side in rows:
            if (node, side) not in seen and digest(elements := cut.elements(unpack.decompress(packed))) == node:
                seen.add((node, side))
                sets.append(elements)
                nodes.append(node)
                sides.append(side)
        forest = link(sets, limit, sides if crossing else None)
        return stars(nodes, [(i, r) for i in range(len(sets)) if (r := forest.find(i)) != i])

    def packed_up(out):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out, strict=True)], ["a", "b"])

    def run(batches):
        key, rows, out = None, [], []
        for batch in batches:
            for block, i, j, node, packed, side in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (block, i, j) != key:
                    out += close(rows)
                    key, rows = (block, i, j), []
                rows.append((node, packed, side))
            if out:
                yield packed_up(out)
                out = []
        if out := close(rows):
            yield packed_up(out)

    return run


def _survivors(limit: Threshold):
    """Groups in a row by (block, i, j): pairs of different roots, one of side True, that sketches don't rule out."""

    def close(rows):
        seen, sides = set(), ([], [])
        for row in rows:
            if (row[0], row[1]) not in seen:
                seen.add((row[0], row[1]))
                sides[row[1]].append(row)
        others, queries = sides
        out = []
        if others and queries:
            may = possible_links([q[4] for q in queries], [q[3] for q in queries], [o[4] for o in others], [o[3] for o in others], limit)
            roots = {r: k for k, r in enumerate({*(q[2] for q in queries), *(o[2] for o in others)})}
            may &= np.array([roots[q[2]] for q in queries])[:, None] != np.array([roots[o[2]] for o in others])[None, :]
            for i, j in np.argwhere(may).tolist():
                q, o = queries[i], others[j]
                if q[0] < o[0] or not o[5]:
                    out.append((q[0], o[0]))
        return out

    def run(batches):
        key, rows, out = None, [], []
        for batch in batches:
            for block, i, j, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (block, i, j) != key:
                    out += close(rows)
                    key, rows = (block, i, j), []
                rows.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out, strict=True)], ["x", "y"])
                out = []
        if out := close(rows):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out, strict=True)], ["x", "y"])

    return run


def member_bitmap(places: DataFrame, bits: int) -> bytearray:
    """Bit `at` of each place (ref, line): put together by the executors in 4 KB pieces, which come as Arrow batches."""
    at = F.col("ref").bitwiseXOR(F.col("line").cast("long") * STEP).bitwiseAND(F.lit((1 << bits) - 1))
    pieces = places.select(at.alias("at")).groupBy(F.floor(F.col("at") / 32768).alias("piece")).agg(F.expr("bitmap_construct_agg(at % 32768)").alias("held")).toArrow()
    out = bytearray(1 << (bits - 3))
    for batch in pieces.to_batches():
        for piece, held in zip(batch.column(0), batch.column(1), strict=True):
            k = piece.as_py() * 4096
            out[k : k + 4096] = held.as_buffer()
    return out


def bits_needed(bitmap: bytearray, most: int) -> int:
    """Of 2^bits, the least power, up to `most`, of which as many places as filled this bitmap fill an eighth."""
    every = len(bitmap) * 8
    clear = every - int(np.bitwise_count(np.frombuffer(bitmap, dtype=np.uint64)).sum())
    places = every * math.log(every / max(1, clear))
    return min(most, max(every.bit_length() - 1, math.ceil(math.log2(8 * places)) if places else 0))


def member_filter(places: DataFrame, least: int = 25, most: int = 28) -> tuple[int, bytearray]:
    """(bits, bitmap) of places (ref, line): 4 MB, or up to 32 MB for more than four million. Beyond 32 million places
    it fills up and rules out less, so more texts meet the join, which drops them; the driver never holds more."""
    held = member_bitmap(places, least)
    bits = bits_needed(held, most)
    return (least, held) if bits <= least else (bits, member_bitmap(places, bits))


def common_tokens(postings: DataFrame, least: int, most: int) -> DataFrame | None:
    """The tokens seen `least` times or more in a sample of postings, `most` at most; None if there are none. They are
    only dealt otherwise, so neither the sample nor the bound changes a result."""
    seen = postings.groupBy("token").agg(F.count("*").alias("seen")).where(F.col("seen") >= least)
    rows = seen.orderBy(F.desc("seen"), "token").limit(most).select("token").toArrow()
    return postings.sparkSession.createDataFrame(rows) if rows.num_rows else None


def _dealt(rows: DataFrame, kernel, schema: str, *order: str) -> DataFrame:
    """Groups by (list or block, i, j), each in one task, rows in order."""
    return rows.repartition(*order[:3]).sortWithinPartitions(*order).mapInArrow(kernel, schema)


def _split(rows: DataFrame, key: str, root: str, size: int) -> DataFrame:
    """Rows of the keys that hold several roots, with `outside` (not of the key's largest root) and the numbers of
    groups that its outside rows, and all its rows, are dealt in."""
    counts = rows.groupBy(key, root).agg(F.count("*").alias("sets"))
    main = counts.groupBy(key).agg(F.max(F.struct("sets", root)).alias("most"), F.count("*").alias("roots"), F.sum("sets").alias("every")).where("roots > 1")
    shape = main.select(key, F.col(f"most.{root}").alias("main"), F.ceil((F.col("every") - F.col("most.sets")) / size).cast("int").alias("groups"), F.ceil(F.col("every") / size).cast("int").alias("parts"))
    return rows.join(shape, key).withColumn("outside", F.col(root) != F.col("main")).drop("main")


def _grid(open_: DataFrame, key: str, member: str, *columns: str) -> DataFrame:
    """Outside rows of each key against all its rows, dealt by group and part; side: whether a row is a query."""
    part = lambda n: F.pmod(F.xxhash64(member), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    queries = open_.where("outside").select(key, part("groups").alias("i"), every("parts").alias("j"), member, F.lit(True).alias("side"), *columns)
    others = open_.select(key, every("groups").alias("i"), part("parts").alias("j"), member, F.lit(False).alias("side"), *columns)
    return queries.unionByName(others)


def possible_blocks(lists: DataFrame, nodes: DataFrame, limit: Threshold, sketch_sets: int) -> DataFrame:
    """(id, root) of what the pairs of each list that sketches leave connect; nodes: id, n, bits."""
    long = lists.groupBy("list").agg(F.ceil(F.count("*") / sketch_sets).cast("int").alias("parts")).where("parts > 1")
    listed = lists.join(long, "list", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("nid"), F.col("parts")).cast("int"))
    hub = F.when(F.col("part") == 0, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("part"))
    met = listed.select("list", F.lit(0).alias("i"), F.explode(hub).alias("j"), F.col("nid").alias("id"))
    drawn = met.join(nodes, "id").select("list", "i", "j", "id", "n", "bits")
    possible = saved(_dealt(drawn, _possible(limit), "a long, b long", "list", "i", "j"))
    blocks = components(possible)
    if long.isEmpty():
        return blocks
    rows = lists.join(long.select("list"), "list").join(blocks.withColumnRenamed("id", "nid"), "nid", "left").select("list", F.col("nid").alias("id"), F.coalesce("root", "nid").alias("root"))
    open_ = saved(_split(rows, "list", "root", sketch_sets))
    if open_.isEmpty():
        return blocks
    dealt = _grid(open_.join(nodes, "id"), "list", "id", "root", "n", "bits")
    return components(possible.unionByName(_dealt(dealt, _bridges(limit), "a long, b long", "list", "i", "j")))


def set_components(texts: DataFrame, rows: DataFrame, cut: Cut, tokens_of: Tokens | None, limit: Threshold, link: Link, *, chunk_sets: int, chunk_words: int, sketch_sets: int = 4096, sample: int = 64, common_seen: int = 64) -> DataFrame:
    """(node, root) of each node that is linked to another, among the units of texts (ref, text); rows: ROWS of them,
    with their tokens where tokens_of is None.

    chunk_sets and chunk_words bound what meets in one task as texts, sketch_sets what meets as sketches (twice
    as many at most). A token that common_seen nodes of one in `sample` hold is dealt by node.
    """
    context = texts.sparkSession.sparkContext
    text = texts.select("ref", "text")
    nid = F.expr("cast(conv(hex(substring(node, 1, 8)), 16, -10) as bigint)")
    held = ["n", "bits", "ref", "line", *(["tokens"] if tokens_of is None else [])]
    nodes = saved(rows.where("n > 0").groupBy("node").agg(F.first(F.struct(*held)).alias("x")).select("node", "x.*").withColumn("id", nid))
    if tokens_of is None:
        postings = nodes.select(F.explode("tokens").alias("token"), F.col("id").alias("nid"))
        shown = nodes.where(F.pmod(F.col("id"), F.lit(sample)) == 0).select(F.explode("tokens").alias("token"))
    else:
        listing = lambda some: some.select("text").mapInArrow(_postings(cut, tokens_of), "token long, nid long")
        postings, shown = listing(text), listing(text.where(F.pmod(F.col("ref"), F.lit(sample)) == 0))
    common = common_tokens(shown, common_seen, 1 << 16)
    salt = F.lit(-1)
    if common is not None:
        postings = postings.join(F.broadcast(common.withColumn("common", F.lit(True))), "token", "left")
        salt = F.when(F.col("common"), F.pmod(F.xxhash64("nid"), F.lit(1 << 20)).cast("int")).otherwise(-1)
    salted = postings.select("token", "nid", salt.alias("salt"))
    lists = saved(salted.repartition("token", "salt").sortWithinPartitions("token").mapInArrow(_lists(sketch_sets), "list long, nid long").distinct())
    blocks = possible_blocks(lists, nodes.select("id", "n", "bits"), limit, sketch_sets)
    placed = nodes.join(blocks, "id").select("id", "node", "n", "bits", "ref", "line", F.col("root").alias("block"))
    share = placed.groupBy("block").agg(F.count("*").alias("sets"), F.sum("n").alias("total"))
    share = share.select("block", F.ceil(F.greatest(F.col("sets") / chunk_sets, F.col("total") / chunk_words)).cast("int").alias("chunks"))
    placed = saved(placed.join(share, "block").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")))

    def met(where: DataFrame, crossing: bool) -> DataFrame:
        """where: ref, line, node, block, i, j, side."""
        bits, held = member_filter(where)
        bitmap = context.broadcast(held)
        members = text.mapInArrow(_members(cut, bitmap, bits), "ref long, line int, packed binary")
        dealt = members.join(where, ["ref", "line"]).select("block", "i", "j", "node", "packed", "side")
        out = saved(_dealt(dealt, _linked(cut, limit, link, crossing), "a binary, b binary", "block", "i", "j", "node"))
        bitmap.destroy()
        return out

    spread = F.when(F.col("chunk") == 0, F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array("chunk"))
    stars = met(placed.select("ref", "line", "node", "block", F.lit(0).alias("i"), F.explode(spread).alias("j"), F.lit(False).alias("side")), False)
    done = components(stars)
    # Only blocks of several chunks that fell into several components go on.
    apart = placed.where("chunks > 1").join(done.select(F.col("id").alias("node"), "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_ = saved(_split(apart, "block", "root", sketch_sets))
    if open_.isEmpty():
        return done.select(F.col("id").alias("node"), "root")
    dealt = _grid(open_, "block", "node", "root", "n", "bits", "outside")
    pairs = saved(_dealt(dealt, _survivors(limit), "x binary, y binary", "block", "i", "j", "node", "side").distinct())
    batches = pairs.groupBy("x").agg(F.ceil(F.count("*") / chunk_sets).cast("int").alias("batches"))
    first = batches.select(F.col("x").alias("block"), F.col("x").alias("node"), F.explode(F.sequence(F.lit(0), F.col("batches") - 1)).alias("j"), F.lit(True).alias("side"))
    second = pairs.join(batches, "x").select(F.col("x").alias("block"), F.col("y").alias("node"), F.pmod(F.xxhash64("y"), F.col("batches")).cast("int").alias("j"), F.lit(False).alias("side"))
    where = first.unionByName(second).join(open_.select("node", "ref", "line").distinct(), "node")
    more = met(saved(where.select("ref", "line", "node", "block", F.lit(0).alias("i"), "j", "side")), True)
    return components(stars.unionByName(more)).select(F.col("id").alias("node"), "root")
