"""Nearest neighbours by multi-index hashing of learned binary codes.

A code holds the signs of a unit vector turned by rotations that a bounded sample has taught to lose little when
signs are taken. It is cut into substrings, and each substring has an index of its own, dealt to cells by its first
bits. By the pigeonhole principle two codes within a Hamming radius r agree in at least one of m substrings up to
r / m bits, so probing every cell that holds such substrings retrieves every code within r. A pair belongs to the
first substring that retrieves it and is seen once.

Radii follow the data. The k-th best cosine known so far can only rise; codes of vectors that lie nearer than it
are, up to a stated number of deviations, within a radius that its angle gives. A sample's cosines give a first
bound; a first probe at a radius of about `gather` codes tightens it; a second one, at the radius that the
tightened bound asks for, retrieves all that count. Cells rank what they retrieve by vectors rounded to 16 bits,
with bounds of the error, and let go only what can't be among the nearest; what is left is ranked by the vectors
themselves. No pairs leave a cell but those few.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.storage import saved_table

SUBSTRING = 16
NODE = ["h1", "h2"]
ASKED = ["q1", "q2"]


@functools.lru_cache(maxsize=8)
def _random_parts(dims: int, bits: int, seed: int) -> tuple[np.ndarray, ...]:
    """Random orthonormal columns, as many together as dims allows, until there are `bits`."""
    rng, parts, left = np.random.default_rng([seed, dims]), [], bits
    while left:
        q, r = np.linalg.qr(rng.standard_normal((dims, min(dims, left))))
        parts.append(q * np.sign(np.diag(r)))
        left -= parts[-1].shape[1]
    return tuple(parts)


def _learned(units: np.ndarray, part: np.ndarray, steps: int) -> np.ndarray:
    """Columns of the same span, turned until signs lose as little of the sample as they can."""
    turned, turn = units @ part, np.eye(part.shape[1])
    for _ in range(steps):
        left, _, right = np.linalg.svd(turned.T @ np.sign(turned @ turn))
        turn = left @ right
    return part @ turn


def unit(rows: np.ndarray) -> np.ndarray:
    x = rows / np.abs(rows).max(axis=1, keepdims=True)  # so that no square over- or underflows
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def hamming(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Different bits of each left code (rows of 64-bit words) and each right one."""
    out = np.zeros((len(left), len(right)), dtype=np.uint16)
    for w in range(left.shape[1]):
        out += np.bitwise_count(left[:, w][:, None] ^ right[:, w][None, :])
    return out


@dataclass
class Model:
    """Rotations, and the sample that they were learned from, by length of vector."""

    bits: int
    seed: int
    rotations: dict[int, np.ndarray] = field(default_factory=dict)
    sample: dict[int, np.ndarray] = field(default_factory=dict)
    codes: dict[int, np.ndarray] = field(default_factory=dict)
    deviations: float = 2.0

    @classmethod
    def learn(cls, vectors: list[list[float]], bits: int, seed: int, steps: int, deviations: float) -> Model:
        model = cls(bits, seed, deviations=deviations)
        by: dict[int, list] = {}
        for v in vectors:
            by.setdefault(len(v), []).append(v)
        for dims, rows in sorted(by.items()):
            units = unit(np.array(rows, dtype=np.float64))
            model.rotations[dims] = np.concatenate([_learned(units, part, steps) for part in _random_parts(dims, bits, seed)], axis=1)
            model.sample[dims], model.codes[dims] = units.astype(np.float32), model.encode(units)
            model.deviations = max(model.deviations, model._spread(units, model.codes[dims]))
        return model

    def encode(self, units: np.ndarray) -> np.ndarray:
        dims = units.shape[1]
        turn = self.rotations.get(dims)
        if turn is None:
            turn = np.concatenate(_random_parts(dims, self.bits, self.seed), axis=1)
        packed = np.packbits(units @ turn > 0, axis=1)
        return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)

    def _spread(self, units: np.ndarray, codes: np.ndarray, most: int = 256, near: int = 10, share: float = 0.98) -> float:
        """By how many deviations the codes of near vectors of the sample differ more than their angles say, at the given share of them."""
        n, some = len(units), units[:most]
        if n < 3:
            return 0.0
        cosines = some @ units.T
        cosines[np.arange(len(some)), np.arange(len(some))] = -2
        at = np.argsort(-cosines, axis=1)[:, : min(near, n - 1)]
        p = np.arccos(np.clip(np.take_along_axis(cosines, at, 1), -1, 1)) / math.pi
        apart = np.take_along_axis(hamming(codes[:most], codes).astype(float), at, 1)
        return float(np.quantile((apart - self.bits * p - 1) / np.sqrt(self.bits * p * (1 - p) + 1e-9), share))

    def radius(self, cosine: np.ndarray) -> np.ndarray:
        """The radius that codes of vectors at this cosine or nearer lie in; nan asks for all."""
        p = np.arccos(np.clip(cosine, -1, 1)) / math.pi
        reach = np.floor(self.bits * p + self.deviations * np.sqrt(self.bits * p * (1 - p)) + 1)
        return np.where(np.isnan(cosine), self.bits, np.minimum(reach, self.bits)).astype(np.int64)


def allowances(radius: np.ndarray, m: int) -> np.ndarray:
    """How many bits each of m substrings may differ in, so that codes within the radius agree so far in one of
    them at least; -1 where a substring needn't be looked at."""
    a, b = np.divmod(np.asarray(radius, dtype=np.int64), m)
    return a[:, None] - (np.arange(m)[None, :] > b[:, None])


def substrings(codes: np.ndarray) -> np.ndarray:
    return codes.view(np.uint16)


@functools.lru_cache(maxsize=64)
def _masks(width: int, most: int) -> np.ndarray:
    every = np.arange(1 << width, dtype=np.int64)
    return every[np.bitwise_count(every) <= most]


def probes(codes: np.ndarray, radius: np.ndarray, width: int) -> list[np.ndarray]:
    """For each code, the cells (substring number, then its first `width` bits) that its radius reaches."""
    parts, allowed = substrings(codes).astype(np.int64) >> (SUBSTRING - width), allowances(radius, codes.shape[1] * 64 // SUBSTRING)
    out = []
    for row, most in zip(parts, allowed.tolist(), strict=True):
        out.append(np.concatenate([(s << SUBSTRING) | (row[s] ^ _masks(width, min(a, width))) for s, a in enumerate(most) if a >= 0] or [row[:0]]))
    return out


def _table(columns: dict, kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[name], kind) for name, kind in kinds.items()], list(kinds))


def _ddl(kinds: dict[str, pa.DataType]) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.float64(): "double", pa.list_(pa.int32()): "array<int>"}
    return ", ".join(f"{name} {names[kind]}" for name, kind in kinds.items())


def _alike(column: pa.Array):
    """(length, row numbers, matrix) of the vectors of each length, at most 1,000 together."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    for dims in np.unique(sizes):
        at = np.flatnonzero(sizes == dims)
        for a in range(0, len(at), 1000):
            part = at[a : a + 1000]
            yield int(dims), part, column.take(pa.array(part)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(part), int(dims))


CODED = {"h1": pa.int64(), "h2": pa.int64(), "dims": pa.int32(), "code": pa.binary(), "parts": pa.list_(pa.int32()), "rounded": pa.binary(), "scale": pa.float64(), "error": pa.float64()}
OPENED = {"q1": pa.int64(), "q2": pa.int64(), "dims": pa.int32(), "code": pa.binary(), "turned": pa.binary(), "first": pa.int32(), "last": pa.int32()}
PROBED = {"q1": pa.int64(), "q2": pa.int64(), "dims": pa.int32(), "code": pa.binary(), "turned": pa.binary(), "radius": pa.int32(), "cells": pa.list_(pa.int32())}
FOUND = {"q1": pa.int64(), "q2": pa.int64(), "h1": pa.int64(), "h2": pa.int64(), "low": pa.float64(), "high": pa.float64()}


def _code(model: Model):
    """Vectors (h1, h2, embedding) to their codes, substrings, and coordinates rounded to 16 bits with the norm of what rounding took."""

    def run(batches):
        for batch in batches:
            h1, h2 = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for dims, at, rows in _alike(batch.column(2)):
                units = unit(rows)
                codes, scale = model.encode(units), np.abs(units).max(axis=1) / 32767
                rounded = np.rint(units / scale[:, None]).astype(np.int16)
                error = np.sqrt(((units - rounded * scale[:, None]) ** 2).sum(axis=1))
                yield _table({"h1": h1[at], "h2": h2[at], "dims": np.full(len(at), dims, np.int32), "code": [c.tobytes() for c in codes], "parts": list(substrings(codes).astype(np.int32)), "rounded": [r.tobytes() for r in rounded], "scale": scale, "error": error}, CODED)

    return run


def _open(model: Model, k: int, place: float):
    """Queries (q1, q2, embedding) with the radii of their first and last probe, as the sample tells: at the first
    as many of its codes lie within as `place` says, at the last all that its k-th cosine asks for."""

    def run(batches):
        for batch in batches:
            q1, q2 = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for dims, at, rows in _alike(batch.column(2)):
                units = unit(rows)
                codes, seen = model.encode(units), model.sample.get(dims)
                first = last = np.full(len(at), model.bits)
                if seen is not None and len(seen) > k:
                    best = np.concatenate([np.partition(units[a : a + 64] @ seen.T, -(k + 1), axis=1)[:, -(k + 1)] for a in range(0, len(at), 64)])
                    nth = min(len(seen), max(k + 1, math.ceil(place))) - 1
                    reach = np.concatenate([np.partition(hamming(codes[a : a + 64], model.codes[dims]), nth, axis=1)[:, nth] for a in range(0, len(at), 64)])
                    last = model.radius(best - 1e-6)
                    first = np.minimum(reach, last)
                yield _table({"q1": q1[at], "q2": q2[at], "dims": np.full(len(at), dims, np.int32), "code": [c.tobytes() for c in codes], "turned": [u.tobytes() for u in units.astype(np.float32)], "first": first.astype(np.int32), "last": last.astype(np.int32)}, OPENED)

    return run


def _probe(bits: int, width: int):
    """Queries of PROBED without cells, with the cells that they probe."""

    def run(batches):
        for batch in batches:
            codes = np.frombuffer(b"".join(batch.column(3).to_pylist()), dtype=np.uint64).reshape(batch.num_rows, -1)
            radius = batch.column(5).to_numpy(zero_copy_only=False)
            for a in range(0, batch.num_rows, 256):
                cells = probes(codes[a : a + 256], radius[a : a + 256], width)
                part = batch.slice(a, 256)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cells, pa.list_(pa.int32()))], list(PROBED))

    return run


def _meet(k: int):
    """Codes and queries of one cell: for each query what it retrieves here, and nowhere before, that may be among
    its k + 1 nearest, with bounds of its cosine."""

    def run(key: tuple, held: pa.Table, asking: pa.Table) -> pa.Table:
        if not held.num_rows or not asking.num_rows:
            return pa.Table.from_batches([_table({name: [] for name in FOUND}, FOUND)])
        dims, cell = key[0].as_py(), key[1].as_py() >> SUBSTRING
        words = lambda t, name, kind: np.frombuffer(b"".join(t.column(name).to_pylist()), dtype=kind).reshape(t.num_rows, -1)
        numbers = lambda t, name: t.column(name).to_numpy()
        codes, rounded, scale, error = words(held, "code", np.uint64), words(held, "rounded", np.int16), numbers(held, "scale"), numbers(held, "error")
        asked, units, radius = words(asking, "code", np.uint64), words(asking, "turned", np.float32).astype(np.float64), numbers(asking, "radius")
        h1, h2, q1, q2 = numbers(held, "h1"), numbers(held, "h2"), numbers(asking, "q1"), numbers(asking, "q2")
        vectors, parts = rounded * scale[:, None], substrings(codes)
        out = {name: [] for name in FOUND}
        for a in range(0, len(asked), 256):
            mine, reach = asked[a : a + 256], radius[a : a + 256]
            allowed, own = allowances(reach, parts.shape[1]), substrings(mine)
            near = hamming(mine, codes) <= reach[:, None]
            for s in range(cell + 1):
                agrees = np.bitwise_count(own[:, s][:, None] ^ parts[:, s][None, :]) <= allowed[:, s][:, None]
                near &= agrees if s == cell else ~agrees
            if not near.any():
                continue
            cosine = np.where(near, units[a : a + 256] @ vectors.T, -9.0)
            slack = error + 1e-6
            low, high = cosine - slack, cosine + slack
            if len(codes) > k:
                near &= high >= np.partition(low, -(k + 1), axis=1)[:, -(k + 1)][:, None]
            q, v = np.nonzero(near)
            for name, values in zip(FOUND, (q1[a + q], q2[a + q], h1[v], h2[v], low[q, v], high[q, v]), strict=True):
                out[name].append(values)
        joined = {name: np.concatenate(parts) if parts else [] for name, parts in out.items()}
        return pa.Table.from_batches([_table(joined, FOUND)])

    return run


SCORED = {"q1": pa.int64(), "q2": pa.int64(), "h1": pa.int64(), "h2": pa.int64(), "score": pa.float64()}


def _score(batches):
    """Pairs with both vectors to their cosines in double precision."""
    for batch in batches:
        ids = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
        for _, at, left in _alike(batch.column(4)):
            right = next(_alike(batch.column(5).take(pa.array(at))))[2]
            powers = [-np.frexp(np.abs(x).max(axis=1, keepdims=True))[1] for x in (left, right)]  # exact, and no square over- or underflows
            left, right = (np.ldexp(x, p) for x, p in zip((left, right), powers, strict=True))
            norms = np.sqrt(np.einsum("ij,ij->i", left, left)) * np.sqrt(np.einsum("ij,ij->i", right, right))
            yield _table({**{name: x[at] for name, x in zip(SCORED, ids, strict=False)}, "score": np.einsum("ij,ij->i", left, right) / norms}, SCORED)


def _usable(vectors: DataFrame, names: list[str]) -> DataFrame:
    """vec_id, embedding and its two hashes, of rows that can be compared."""
    vector = F.col("embedding")
    if not vectors.schema["embedding"].dataType.simpleString() == "array<float>":
        vector = vector.cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(vector, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("embedding")).where(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)))
    return rows.select("vec_id", "embedding", F.xxhash64("embedding").alias(names[0]), F.xxhash64(F.lit(1), "embedding").alias(names[1]))


def _retrieve(codes: DataFrame, asked: DataFrame, k: int, bits: int, width: int, chunk: int) -> DataFrame:
    """FOUND for queries (q1, q2, dims, code, turned, radius): what lies within their radii and may be among the k + 1 nearest."""
    names = [c for c in PROBED if c != "cells"]
    probing = saved_table(asked.select(*names).mapInArrow(_probe(bits, width), _ddl(PROBED)))
    reach = probing.withColumn("cell", F.explode("cells")).drop("cells")
    cells = codes.select("dims", F.posexplode("parts").alias("s", "part"), "h1", "h2", "code", "rounded", "scale", "error")
    cells = cells.withColumn("cell", F.shiftleft("s", SUBSTRING).bitwiseOR(F.shiftright("part", SUBSTRING - width))).drop("s", "part")
    where = ["dims", "cell"]
    pieces = lambda rows, name: rows.groupBy(*where).agg(F.ceil(F.count("*") / chunk).cast("int").alias(name))
    plan = saved_table(pieces(cells, "held").join(pieces(reach, "asking"), where))
    dealt = lambda rows, ids, own, own_name, other, other_name: rows.join(plan, where).select(
        *where, F.pmod(F.xxhash64(*ids), F.col(own)).cast("int").alias(own_name), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other_name), *[c for c in rows.columns if c not in where])
    left, right = dealt(cells, NODE, "held", "i", "asking", "j"), dealt(reach, ASKED, "asking", "j", "held", "i")
    by = [*where, "i", "j"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_meet(k), _ddl(FOUND))


def _best(found: DataFrame, k: int) -> DataFrame:
    """Of what cells let through, what may still be among the k + 1 nearest, and the least that the (k + 1)-th reaches."""
    of = Window.partitionBy(*ASKED)
    placed = found.withColumn("place", F.row_number().over(of.orderBy(F.desc("low"))))
    bound = placed.withColumn("reached", F.max(F.when(F.col("place") == k + 1, F.col("low"))).over(of))
    return bound.where(F.col("reached").isNull() | (F.col("high") >= F.col("reached"))).drop("place")


def search(vectors: DataFrame, queries: DataFrame, *, k: int = 5, bits: int = 128, sample_rows: int = 20_000, sample_bytes: int = 32_000_000, steps: int = 20, deviations: float = 2.0, gather: int = 200, cell: int = 4096, chunk: int = 4096, seed: int = 12) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of vectors (vec_id, embedding) with the largest cosine to each row
    of queries (likewise), nearest first, ties to the smaller vec_id; a query's own row (the same id and vector) is left out. With fewer rows, all of them.

    Rows without an id, and those whose vector is null, empty, zero or holds a null or non-finite component, take no
    part, as queries or candidates. Vectors of different lengths never meet. Rows repeated in full count once; an
    id with two vectors is two rows. Other columns are not read; an empty table gives none.

    bits: a multiple of 64. Rotations are learned from sample_rows vectors at most (and sample_bytes of them as
    floats); every row is indexed. deviations: how far a near vector's code may lie beyond what its angle says
    (more, if the sample's codes do) before it can be missed. cell, chunk: rows of a cell aimed at, and of the pieces in
    which larger ones meet their queries; a query is sent to each cell that it probes, so small cells cost more. Where the nearest lie far off, as in directions
    without any structure, radii are wide and most cells are probed: then blocks of queries meet all rows.
    """
    spark = vectors.sparkSession
    rows, asking = _usable(vectors, NODE), _usable(queries, ASKED)
    nodes = saved_table(rows.groupBy(*NODE).agg(F.first("embedding").alias("embedding")))
    asked = saved_table(asking.groupBy(*ASKED).agg(F.first("embedding").alias("embedding")))
    size = nodes.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("embedding").cast("long")), F.lit(0)).alias("numbers")).first()
    share = min(1.0, sample_rows / max(1, size["n"]), sample_bytes / max(1, 4 * size["numbers"]))
    sample = nodes.where(F.pmod(F.xxhash64(F.lit(seed), *NODE), F.lit(1 << 30)) < math.ceil(share * (1 << 30))).orderBy(*NODE).select("embedding").collect()
    model = Model.learn([r["embedding"] for r in sample], bits, seed, steps, deviations)
    width = min(SUBSTRING, max(0, math.ceil(math.log2(max(1, size["n"]) / cell))))
    codes = saved_table(nodes.mapInArrow(_code(model), _ddl(CODED)))
    opened = saved_table(asked.mapInArrow(_open(model, k, gather * len(sample) / max(1, size["n"])), _ddl(OPENED)))

    first = saved_table(_best(_retrieve(codes, opened.withColumn("radius", F.col("first")), k, bits, width, chunk), k))
    reached = first.groupBy(*ASKED).agg(F.max("reached").alias("reached"))
    p = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("reached")))) / math.pi
    needed = F.coalesce(F.least(F.lit(bits), F.floor(bits * p + model.deviations * F.sqrt(bits * p * (1 - p)) + 1)), F.lit(bits))
    again = saved_table(opened.join(reached, ASKED, "left").withColumn("radius", F.least("last", needed.cast("int"))).where(F.col("radius") > F.col("first")).drop("reached"))
    second = _best(_retrieve(codes, again, k, bits, width, chunk), k)
    left = first.join(again.select(*ASKED), ASKED, "left_anti").unionByName(second).select(*ASKED, *NODE)

    scored = left.join(nodes, NODE).select(*ASKED, *NODE, F.col("embedding").alias("found")).join(asked, ASKED).select(*ASKED, *NODE, "embedding", "found")
    scored = saved_table(scored.mapInArrow(_score, _ddl(SCORED)))
    in_node = rows.select(*NODE, "vec_id").distinct().withColumn("place", F.row_number().over(Window.partitionBy(*NODE).orderBy("vec_id"))).where(F.col("place") <= k + 1).drop("place")
    ranked = scored.join(in_node, NODE).withColumn("place", F.row_number().over(Window.partitionBy(*ASKED).orderBy(F.desc("score"), "vec_id"))).where(F.col("place") <= k + 1)
    given = ranked.join(asking.select(*ASKED, F.col("vec_id").alias("query_id")).distinct(), ASKED)
    own = (F.col("vec_id") == F.col("query_id")) & (F.col("q1") == F.col("h1")) & (F.col("q2") == F.col("h2"))
    rank = F.row_number().over(Window.partitionBy("query_id", *ASKED).orderBy(F.desc("score"), "vec_id"))
    return given.where(~own).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
