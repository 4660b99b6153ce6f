"""Connected components, and clusters of similar vectors."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.sources.checkpoints import saved


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, root) for the ids of edges (a, b): the smallest id of the component.

    Rounds of hooking to the smallest neighbour's label and of jumping along labels, each on saved tables.
    """
    edges = saved(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = saved(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "id"))
    while True:
        near = edges.join(labels.select(F.col("id").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near")).withColumnRenamed("a", "id")
        hooked = labels.join(near, "id").select("id", "root", F.least("root", "near").alias("low"))
        over = labels.select(F.col("id").alias("low"), F.col("root").alias("top"))
        moved = saved(hooked.join(over, "low").select("id", F.col("root").alias("before"), F.least("low", "top").alias("root")))
        labels = moved.select("id", "root")
        if moved.where("root <> before").isEmpty():
            return labels


@dataclass(frozen=True)
class Cells:
    """Pivots, and how far two unit vectors of a pair may lie apart."""

    pivots: np.ndarray
    far: float

    def deal(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """The home cell of each vector (its nearest pivot), its distance from that, and the later cells that may be
        home to a partner: by the triangle inequality their pivot is at most twice the pair's distance farther off."""
        away = np.sqrt(np.maximum(0, 2 - 2 * units @ self.pivots.T))
        home = away.argmin(axis=1)
        least = away[np.arange(len(units)), home]
        near = (away <= least[:, None] + 2 * self.far + 1e-6) & (np.arange(len(self.pivots))[None, :] > home[:, None])
        return home, least, [np.flatnonzero(row) for row in near]


def _spread_out(units: np.ndarray, n: int) -> np.ndarray:
    """n of the vectors, each the farthest from those taken before."""
    taken, near = [0], units @ units[0]
    while len(taken) < min(n, len(units)):
        k = int(near.argmin())
        if near[k] > 1 - 1e-9:
            break
        taken.append(k)
        near = np.maximum(near, units @ units[k])
    return units[taken]


def choose_cells(sample: np.ndarray, threshold: float, most_copies: float = 4.0, sizes: tuple[int, ...] = (1, 8, 32, 128, 512)) -> Cells:
    """The number of pivots, of `sizes`, at which a sample's vectors meet the fewest others, while a vector visits fewer
    than most_copies cells besides its home. Directions without structure leave one cell: then all rows meet, in blocks."""
    far, best = math.sqrt(max(0.0, 2 - 2 * threshold)), None
    for n in sizes:
        cells = Cells(_spread_out(sample, n), far)
        home, _, visits = cells.deal(sample)
        held = np.bincount(home, minlength=len(cells.pivots)).astype(float)
        guests = np.bincount(np.concatenate(visits).astype(int), minlength=len(cells.pivots)) if len(sample) else held
        cost = (held * (held / 2 + guests)).sum()
        if guests.sum() <= most_copies * len(sample) and (best is None or cost < best[0]):
            best = cost, cells
    return best[1]


def _unit(rows: list) -> np.ndarray:
    x = np.array(rows, dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


DEALT = "g {g}, dims int, cell int, id {id}, kind string, u array<double>"


def _deal(cells: dict[int, Cells]):
    def run(batches):
        for batch in batches:
            out = []
            for dims, part in batch.groupby(batch["v"].map(len)):
                units = _unit(part["v"].tolist())
                use = cells.get(dims) or Cells(units[:0], 0.0)
                home, least, visits = use.deal(units) if len(use.pivots) else (np.zeros(len(units), int), np.full(len(units), 9.0), [()] * len(units))
                for g, i, u, h, d, others in zip(part["g"], part["id"], units, home, least, visits, strict=True):
                    out.append((g, dims, int(h), i, "core" if d <= use.far / 2 - 1e-6 else "home", u))
                    out += [(g, dims, int(c), i, "guest", u) for c in others]
            yield pd.DataFrame(out, columns=["g", "dims", "cell", "id", "kind", "u"])

    return run


def _linked(threshold: float):
    """Rows of two chunks of a cell to edges that connect what the pairs of home rows with the other chunk's connect."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        i, j = int(rows["i"].iloc[0]), int(rows["j"].iloc[0])
        units, side, kind, ids = np.array(rows["u"].tolist()), rows["chunk"].to_numpy(), rows["kind"].to_numpy(), rows["id"].to_numpy()
        left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
        links = units[left] @ units[right].T >= threshold
        links &= (kind[left][:, None] != "guest") | (kind[right][None, :] != "guest")
        links &= (kind[left][:, None] != "core") | (kind[right][None, :] != "core")
        a, b = np.nonzero(links)
        graph = smallest_linked(len(rows), left[a], right[b])
        apart = np.flatnonzero(graph != np.arange(len(rows)))
        return pd.DataFrame({"a": ids[graph[apart]], "b": ids[apart]})

    return run


def smallest_linked(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n rows the smallest row that links (a, b) connect it with."""
    label = np.arange(n)
    while True:
        least = label.copy()
        np.minimum.at(least, a, label[b])
        np.minimum.at(least, b, label[a])
        least = least[least]
        if (least == label).all():
            return label
        label = least


def similarity_clusters(vectors: DataFrame, threshold: float, by: str = "label", vec_id: str = "vec_id", vector: str = "embedding", sample_rows: int = 4096, chunk: int = 1024, zeros_link: bool = False) -> DataFrame:
    """(vec_id, cluster_id): components of pairs of one group whose cosine reaches the threshold, none of them lost.

    A metric index: unit vectors live with their nearest pivot and visit later pivots that may be home to a partner,
    by the triangle inequality. Rows of a cell meet in pairs of chunks, whatever its size, and only what connects them
    leaves. Rows within half of the pair's distance from a pivot are linked with each other without being compared.
    Equal vectors are one row. Pivots come from a sample of sample_rows vectors at most.

    Rows without a group, and null, zero or non-finite vectors, are clusters of their own, as are rows without an id.
    With zeros_link, vectors that are zero or hold NaN link with all of their group, as "product of a and b >= threshold *
    length of a * length of b" holds for them in SQL, where NaN equals itself.
    """
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(by).alias("g"), F.col(vec_id).alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("g").isNotNull() & F.col("id").isNotNull() & F.coalesce(fine, F.lit(False)))
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("g", "id")}
    distinct = saved(rows.groupBy("g", "v").agg(F.min("id").alias("id")))
    n = distinct.count()
    share = min(1.0, sample_rows / max(1, n))
    by_dims: dict[int, list] = {}
    for r in distinct.where(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < math.ceil(share * (1 << 30))).orderBy("g", "id").select("v").collect():
        by_dims.setdefault(len(r["v"]), []).append(r["v"])
    cells = {dims: choose_cells(_unit(found), threshold) for dims, found in by_dims.items()}
    dealt = saved(distinct.select("g", "id", "v").mapInPandas(_deal(cells), DEALT.format(**kinds)))
    where = ["g", "dims", "cell"]
    centre = dealt.where("kind = 'core'").groupBy(*where).agg(F.min("id").alias("a"))
    stars = dealt.where("kind = 'core'").join(centre, where).where("id <> a").select("a", F.col("id").alias("b"))
    chunks = dealt.groupBy(*where).agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks"), F.count_if(F.col("kind") != "guest").alias("homes")).where("homes > 0").drop("homes")
    placed = dealt.join(chunks, where).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    met = placed.select(*where, F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "id", "kind", "u").groupBy(*where, "i", "j")
    edges = stars.unionByName(met.applyInPandas(_linked(threshold), f"a {kinds['id']}, b {kinds['id']}"))
    same = rows.join(distinct.withColumnRenamed("id", "a"), ["g", "v"]).where("a <> id").select("a", F.col("id").alias("b"))
    edges = edges.unionByName(same)
    if zeros_link:
        whole = vectors.select(F.col(by).alias("g"), F.col(vec_id).alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("g").isNotNull() & F.col("id").isNotNull() & F.forall("v", lambda x: x.isNotNull()))
        hubs = whole.where(F.exists("v", lambda x: F.isnan(x)) | F.forall("v", lambda x: x == 0)).groupBy("g").agg(F.min("id").alias("a"))
        edges = edges.unionByName(whole.join(F.broadcast(hubs), "g").where("a <> id").select("a", F.col("id").alias("b")))
    found = connected_components(edges)
    return vectors.select(F.col(vec_id).alias("id")).join(found, "id", "left").select(F.col("id").alias(vec_id), F.coalesce("root", "id").alias("cluster_id"))


def cluster_report(clusters: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """Number of clusters and singletons, and the size of the largest."""
    sizes = clusters.groupBy(cluster).agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("n_clusters"), F.count_if(F.col("n") == 1).alias("singletons"), F.max("n").alias("largest"))


def largest_clusters(clusters: DataFrame, top: int = 10, cluster: str = "cluster_id") -> DataFrame:
    sizes = clusters.groupBy(cluster).agg(F.count("*").alias("n"))
    """The `top` largest clusters, rank from 1, ties by id."""
    return sizes.orderBy(F.desc("n"), cluster).limit(top).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), cluster)))
