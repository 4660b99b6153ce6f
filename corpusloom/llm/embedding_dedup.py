"""Near-duplicate embeddings with randomised-rotation binary codes.

A unit vector is turned by fixed random rotations and stored, once, as the signs of its coordinates, with the
inner product of the vector and its own code as correction factor, and with its coordinates rounded to a byte for
when it asks. For a rounded vector q and a code, (q . code) / factor is an unbiased estimate of q's inner product
with the coded vector. For a pair at or above the threshold t its error is a share sqrt(1 - t^2) at most of the
factor's own, so a pair is out where estimate plus bound stays below t, and is recomputed, in double precision,
where it doesn't. Codes alone are dealt to tables of sign-bit keys, as many as each label's size asks for by the
chance that a pair at the threshold shares a key in none; vectors are fetched for what is left undecided. Large
buckets are dealt in chunks that meet two at a time, and a pair counts in the first table that both vectors
share, so counts are exact without any pair being emitted.
"""

from __future__ import annotations

import functools
import hashlib
import math

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.components import Forest, components
from corpusloom.llm.storage import saved

NODE = "label long, node binary, vec_id long, vector binary"


@functools.lru_cache(maxsize=8)
def rotation(dims: int, bits: int, seed: int) -> np.ndarray:
    """dims x bits: independent random rotations side by side, cut to the number of bits."""
    rng = np.random.default_rng([seed, dims])
    parts = []
    while sum(p.shape[1] for p in parts) < bits:
        q, r = np.linalg.qr(rng.standard_normal((dims, dims)))
        parts.append(q * np.sign(np.diag(r)))
    return np.concatenate(parts, axis=1)[:, :bits] if parts else np.zeros((dims, 0))


def table_plan(size: Column, threshold: float, miss: float, bucket: int) -> tuple[Column, Column]:
    """(bits of a key, tables) for a label of some size: keys long enough for buckets of about `bucket`, tables enough
    for the miss rate; a label of one bucket needs no key."""
    bits = F.greatest(F.lit(0), F.ceil(F.log2(size / bucket))).cast("int")
    share = F.pow(F.lit(1 - math.acos(threshold) / math.pi), bits)
    return bits, F.when(bits == 0, 1).otherwise(F.ceil(math.log(miss) / F.log(1 - share))).cast("int")


def _nodes(batches):
    """Vectors with a digest that equal vectors share."""
    for batch in batches:
        rows = []
        for vec_id, vector, label in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            raw = np.array(vector, dtype=np.float64)
            raw = (raw + 0.0).tobytes()  # -0.0 is 0.0
            rows.append((label, hashlib.blake2b(raw, digest_size=16, key=str(label).encode()).digest(), vec_id, raw))
        cols = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.binary(), pa.int64(), pa.binary()), strict=True)], ["label", "node", "vec_id", "vector"])


def _keys(units: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    """One key for each vector and table; without bits it is the same for all."""
    signs = units @ rotation(units.shape[1], bits * tables, seed) > 0
    weights = (1 << np.arange(bits, dtype=np.int64))[None, None, :]
    return (signs.reshape(len(units), tables, bits) * weights).sum(axis=2)


def _unit(raws: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raws), dtype=np.float64).reshape(len(raws), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square over- or underflows
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


@dataclass
class Codes:
    """Signs of the turned vectors (packed), correction factors, and the vectors rounded to bytes with their scales."""

    signs: np.ndarray
    factor: np.ndarray
    rounded: np.ndarray
    scale: np.ndarray

    @classmethod
    def of(cls, units: np.ndarray, code_bits: int, seed: int) -> Codes:
        turned = units @ rotation(units.shape[1], code_bits, seed + 1)
        factor = np.abs(turned).sum(axis=1) / math.sqrt(code_bits * code_bits / units.shape[1])
        scale = np.abs(units).max(axis=1) / 127
        return cls(np.packbits(turned > 0, axis=1), factor.astype(np.float32), np.rint(units / scale[:, None]).astype(np.int8), scale.astype(np.float32))

    def part(self, at: np.ndarray) -> Codes:
        return Codes(self.signs[at], self.factor[at], self.rounded[at], self.scale[at])


def estimates(left: Codes, right: Codes, code_bits: int, seed: int) -> np.ndarray:
    """Inner products of the left vectors, rounded, with the right ones, from the right ones' codes."""
    dims = left.rounded.shape[1]
    turned = (left.rounded * left.scale[:, None]) @ rotation(dims, code_bits, seed + 1).astype(np.float32)
    codes = np.unpackbits(right.signs, axis=1, count=code_bits).astype(np.float32) * 2 - 1
    return turned @ codes.T / (math.sqrt(code_bits * code_bits / dims) * right.factor)[None, :]


def undecided(left: Codes, right: Codes, threshold: float, code_bits: int, deviations: float, seed: int) -> np.ndarray:
    """Which pairs the estimates don't rule out."""
    f = right.factor.astype(np.float64)
    noise = deviations * np.sqrt(np.maximum(0, 1 - f * f) / (f * f) / max(1, code_bits - 1) * max(0.0, 1 - threshold * threshold))
    rounding = math.sqrt(left.rounded.shape[1]) / 2 * left.scale[:, None] / f[None, :]
    return estimates(left, right, code_bits, seed) + noise[None, :] + rounding + 1e-5 >= threshold


CODED = "label long, dims int, key_bits int, node binary, keys array<long>, signs binary, factor float, rounded binary, scale float"


def _coded(code_bits: int, seed: int):
    """The stored codes of nodes (label, node, vector, key_bits, tables), with their keys in each table."""

    def run(batches):
        names = [f.split()[0] for f in CODED.split(", ")]
        for batch in batches:
            label, node, vector, bits, tables = (c.to_pylist() for c in batch.columns)
            alike: dict[tuple[int, int, int], list[int]] = {}
            for i, v in enumerate(vector):
                alike.setdefault((len(v) // 8, bits[i], tables[i]), []).append(i)
            for (dims, b, t), at in alike.items():
                for a in range(0, len(at), 1000):
                    part = at[a : a + 1000]
                    units = _unit([vector[i] for i in part])
                    codes, keys = Codes.of(units, code_bits, seed), _keys(units, b, t, seed)
                    cols = [pa.array([label[i] for i in part], pa.int64()), pa.array(np.full(len(part), dims, dtype=np.int32)), pa.array(np.full(len(part), b, dtype=np.int32)), pa.array([node[i] for i in part], pa.binary()), pa.array(list(keys), pa.list_(pa.int64()))]
                    cols += [pa.array([s.tobytes() for s in codes.signs], pa.binary()), pa.array(codes.factor), pa.array([r.tobytes() for r in codes.rounded], pa.binary()), pa.array(codes.scale)]
                    yield pa.RecordBatch.from_arrays(cols, names)

    return run


GROUP = ["label", "dims", "key_bits", "tab", "key", "i", "j"]
GROUPED = "label long, dims int, key_bits int, tab int, key long, i int, j int"


def _in_groups(batches, close):
    """Rows in order of GROUP: what close(group, rows) gives for each group, batch by batch."""
    group, rows, out = None, [], []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[: len(GROUP)] != group:
                if rows:
                    out += close(group, rows)
                group, rows = row[: len(GROUP)], []
            rows.append(row[len(GROUP) :])
        if out:
            yield out
            out = []
    if rows and (out := close(group, rows)):
        yield out


def _sift(threshold: float, code_bits: int, deviations: float, seed: int):
    """Rows (node, side, signs, factor, rounded, scale) of each group: those with pairs left undecided, with their
    place in the group and, as bits, the places of their partners."""

    def close(group, rows):
        if len(rows) < 2:
            return []
        nodes, sides, signs, factor, rounded, scale = map(list, zip(*rows, strict=True))
        codes = Codes(np.frombuffer(b"".join(signs), dtype=np.uint8).reshape(len(rows), -1), np.array(factor, dtype=np.float32), np.frombuffer(b"".join(rounded), dtype=np.int8).reshape(len(rows), -1), np.array(scale, dtype=np.float32))
        side, (i, j) = np.array(sides), group[-2:]
        left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
        open_ = undecided(codes.part(left), codes.part(right), threshold, code_bits, deviations, seed)
        if i == j:
            open_ = np.triu(open_, 1)
        asks = np.zeros((len(rows), len(rows)), dtype=bool)
        asks[np.ix_(left, right)] = open_
        some = asks.any(axis=1) | asks.any(axis=0)
        partners = np.packbits(asks, axis=1)
        return [(*group, nodes[k], k, partners[k].tobytes() if asks[k].any() else b"") for k in np.flatnonzero(some).tolist()]

    def run(batches):
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.binary()]
        for out in _in_groups(batches, close):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [*GROUP, "node", "place", "partners"])

    return run


def _exact(threshold: float, seed: int):
    """Rows (place, node, copies, partners, vector) of each group: the undecided pairs computed; links counted for
    each vector, and a star of what is linked."""

    def close(group, rows):
        places, nodes, copies, partners, vectors = map(list, zip(*rows, strict=True))
        units, weight = _unit(vectors), np.array(copies)
        row_of = {p: k for k, p in enumerate(places)}
        a, b = [], []
        for k, bits in enumerate(partners):
            if bits:
                others = np.flatnonzero(np.unpackbits(np.frombuffer(bits, dtype=np.uint8)))
                a.append(np.full(len(others), k))
                b.append(np.array([row_of[p] for p in others.tolist()]))
        a, b = np.concatenate(a), np.concatenate(b)
        pieces = range(0, len(a), 1 << 16)
        keep = np.concatenate([np.einsum("ij,ij->i", units[a[s : s + (1 << 16)]], units[b[s : s + (1 << 16)]]) >= threshold for s in pieces])
        a, b = a[keep], b[keep]
        bits, table = group[2:4]
        if table and len(a):
            keys = _keys(units, bits, table, seed)
            fresh = np.concatenate([~(keys[a[s : s + 65536]] == keys[b[s : s + 65536]]).any(axis=1) for s in range(0, len(a), 65536)])
            a, b = a[fresh], b[fresh]
        if not len(a):
            return []
        links = np.bincount(a, weight[b], len(nodes)) + np.bincount(b, weight[a], len(nodes))
        forest = Forest()
        for p in np.unique(a * len(nodes) + b).tolist() if len(a) < 4 * len(nodes) else _spanning(a, b, len(nodes)):
            forest.join(*divmod(p, len(nodes)))
        return [(nodes[k], int(links[k]), nodes[forest.find(k)]) for k in np.flatnonzero(links).tolist()]

    def run(batches):
        for out in _in_groups(batches, close):
            yield _counted(out)

    return run


def _spanning(a: np.ndarray, b: np.ndarray, n: int) -> list[int]:
    """Pairs that connect all that (a, b) connect: labels spread along dense links until they rest."""
    label = np.arange(n)
    while True:
        least = label.copy()
        np.minimum.at(least, a, label[b])
        np.minimum.at(least, b, label[a])
        if (least == label).all():
            return [int(label[k]) * n + k for k in range(n) if label[k] != k]
        label = least


def _counted(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.binary()), strict=True)], ["node", "links", "root"])


def dedup_embeddings(vectors: DataFrame, *, threshold: float = 0.93, miss: float = 1e-4, bucket: int = 1024, chunk: int = 512, code_bits: int = 256, deviations: float = 6.0, seed: int = 20) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of vectors (vec_id, embedding, label).

    Rows whose label or vector is null, or whose vector is empty, zero or holds a null or non-finite component,
    link with nothing: no links, their own component, kept. Vectors of different lengths do not link. Equal
    vectors fall together first and count as links of each other. A component is named by its smallest id; rows
    without an id are kept only in components without any id. Other columns are not read; empty tables give none.

    miss: the chance that a pair exactly at the threshold shares no table (far less for closer pairs);
    deviations: how many standard errors an estimate may be off before a pair would be left unchecked.
    """
    vector = F.col("embedding").cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(vector, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("embedding"), F.col("label").cast("long").alias("label"))
    good = F.coalesce(finite & F.col("label").isNotNull(), F.lit(False))
    keyed = saved(rows.where(good).mapInArrow(_nodes, NODE))
    alone = rows.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    nodes = saved(keyed.groupBy("label", "node").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.first("vector").alias("vector")))
    sizes = nodes.groupBy("label").agg(F.count("*").alias("size"))
    key_bits, tables = table_plan(F.col("size"), threshold, miss, bucket)
    planned = nodes.join(sizes, "label").select("label", "node", "vector", key_bits.alias("key_bits"), tables.alias("tables"))
    codes = saved(planned.mapInArrow(_coded(code_bits, seed), CODED))
    where, stored = ["label", "dims", "key_bits", "tab", "key"], ["node", "signs", "factor", "rounded", "scale"]
    places = codes.select("label", "dims", "key_bits", F.posexplode("keys").alias("tab", "key"), *stored)
    hot = places.groupBy(*where).agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks")).where("chunks > 1")
    placed = places.join(hot, where, "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("side", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    paired = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(*where, F.least("side", "o").alias("i"), F.greatest("side", "o").alias("j"), "node", "side", *stored[1:])
    grouped = lambda rows, order: rows.repartition(*GROUP).sortWithinPartitions(*GROUP, order)
    sifted = grouped(paired, "node").mapInArrow(_sift(threshold, code_bits, deviations, seed), f"{GROUPED}, node binary, place int, partners binary")
    fetched = sifted.join(nodes.select("node", "copies", "vector"), "node").select(*GROUP, "place", "node", "copies", "partners", "vector")
    met = saved(grouped(fetched, "place").mapInArrow(_exact(threshold, seed), "node binary, links long, root binary"))
    links = met.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(met.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = nodes.select("node", "copies", "least").join(links, "node", "left").join(roots.withColumnRenamed("id", "node"), "node", "left")
    named = named.select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"), "least")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    facts = saved(named.join(least, "root").select(F.col("node").alias("of"), "n_links", "component_id"))
    known = keyed.select("node", "vec_id").join(facts, F.col("node") == F.col("of"))
    return known.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")).unionByName(alone)
