"""Connected components of a distributed edge list: rounds of hooking, pointer jumping and contraction."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.storage import saved


class Forest:
    """Union by smaller id with path halving."""

    def __init__(self):
        self.parent: dict = {}

    def find(self, x):
        p = self.parent
        if x not in p:
            p[x] = x
            return x
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def join(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if b < a:
            a, b = b, a
        self.parent[b] = a
        return True


def _local(batches):
    forest, given, kind = Forest(), {}, pa.int64()
    for batch in batches:
        kind = batch.column(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.join(a, b)
            given[a] = b
    rows = [(x, r) for x in forest.parent if (r := forest.find(x)) != x]
    for i in range(0, len(rows), 100_000):
        part = rows[i : i + 100_000]
        moved = [given.get(x) != r for x, r in part]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in part], kind), pa.array([r for _, r in part], kind), pa.array(moved, pa.bool_())], ["a", "b", "moved"])


def local_forest(edges: DataFrame) -> DataFrame:
    """Each partition's edges (a, b) as stars, a over b: one edge for each id but the least of a tree, the same
    connections; moved: whether the last edge given for a was another one."""
    kind = edges.schema["a"].dataType.simpleString()
    return edges.select("a", "b").mapInArrow(_local, f"a {kind}, b {kind}, moved boolean")


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every id of edges (a, b) of different ids, root being one id of its component, the same for all of it.

    Edges lead from the larger to the smaller id. In each round all edges up from an id meet in one task, whose
    edges become stars, and each edge then leads to the least id that its upper end leads to. Once neither changes
    any edge each id has one, to an id that has none. No adjacency list of an upper end is ever gathered and only
    emptiness reaches the driver. Three exchanges a round.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    while True:
        stars = saved(local_forest(edges.repartition("a")))  # read twice, worked out once
        up = stars.groupBy("a").agg(F.min("b").alias("top")).select(F.col("a").alias("b"), "top")
        edges = saved(stars.join(up, "b", "left").select("a", F.coalesce("top", "b").alias("b"), (F.col("moved") | F.col("top").isNotNull()).alias("moved")))
        if edges.where("moved").isEmpty():
            break
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
