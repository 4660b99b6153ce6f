"""Quality classifier: a generalised additive model with pairwise interactions.

Texts become a few dozen figures; each figure is cut into bins at quantiles of the training sample. Cyclic
boosting visits the features in turn and fits a shallow tree over the bins to the current residuals, adding
it, damped, to the feature's lookup table. Then the pairs whose grids explain most of what is left get tables
of their own in the same way. A score is the logistic of the intercept plus one table entry for each feature
and pair, so scoring is binning and additions on whole batches.
"""

from __future__ import annotations

import math
import operator
from collections import Counter
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = (
    "log_chars", "log_words", "upper", "digit", "space", "newline", "stop", "symbol", "wide", "control", "byte_entropy", "word_len", "word_len_sd",
    "long_words", "short_words", "distinct_words", "top_word", "repeated_next", "distinct_pairs", "repeated_lines", "line_len", "end_mark", "symbol_words", "caps_words", "top_pair",
)


def _classes() -> np.ndarray:
    table = np.zeros((256, 8))
    for b in range(256):
        c = chr(b)
        k = 6 if b >= 128 else 0 if c.isupper() else 1 if c.isdigit() else 2 if c in " \t" else 3 if c in "\r\n" else 4 if c in ".,;:?'\"-()" else 7 if b < 32 else None if c.isalpha() else 5
        if k is not None:
            table[b, k] = 1
    return table


CLASSES = _classes()


def featurize(text: str | None) -> list[float]:
    """FEATURES of a whole text; a null or empty one gives zeros."""
    text = text or ""
    if not text:
        return [0.0] * len(FEATURES)
    hist = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8), minlength=256)
    size = int(hist.sum())
    upper, digit, space, newline, stop, symbol, wide, control = (hist @ CLASSES / size).tolist()
    share = hist[hist > 0] / size
    words = text.split()
    n = len(words) or 1
    lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) if words else np.zeros(1, dtype=np.int64)
    counts, pairs = Counter(words), Counter(zip(words, words[1:], strict=False))
    lines = [x for x in text.split("\n") if x]
    ends = Counter(w[-1].isalnum() or w[-1] in ".,;:?)" for w in words)
    return [
        math.log1p(len(text)), math.log1p(len(words)), upper, digit, space, newline, stop, symbol, wide, control, float(-(share * np.log2(share)).sum()),
        float(lens.mean()), float(lens.std()), float((lens > 14).mean()), float((lens < 3).mean()), len(counts) / n, max(counts.values(), default=0) / n,
        sum(map(operator.eq, words, words[1:])) / n, len(pairs) / n, 1 - len(set(lines)) / len(lines) if lines else 0.0, math.log1p(len(text) / (len(lines) or 1)),
        sum(x[-1] in ".?!" for x in lines) / (len(lines) or 1), ends[False] / n, sum(map(str.isupper, words)) / n, max(pairs.values(), default=0) / n,
    ]


@dataclass
class Model:
    cuts: list[np.ndarray] = field(default_factory=list)
    intercept: float = 0.0
    singles: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, i], side="right") for i, c in enumerate(self.cuts)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        if self.cuts and len(x):
            b = self.bins(x)
            for i, table in enumerate(self.singles):
                z += table[b[:, i]]
            for (i, j), table in self.pairs.items():
                z += table[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """A shallow regression tree over ordered bins: the best splits in turn, and a Newton step in each leaf."""
    edges = [(0, len(g))]
    G, H = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    part = lambda a, b: (G[b] - G[a]) ** 2 / (H[b] - H[a] + ridge)
    while len(edges) < leaves:
        best = (1e-9, None, None)
        for k, (a, b) in enumerate(edges):
            if b - a > 1:
                m = np.arange(a + 1, b)
                gain = part(a, m) + part(m, b) - part(a, b)
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (gain[i], k, int(m[i]))
        if best[1] is None:
            break
        a, b = edges[best[1]]
        edges[best[1] : best[1] + 1] = [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in edges:
        out[a:b] = (G[b] - G[a]) / (H[b] - H[a] + ridge)
    return out


def _grid_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """One cut of each axis of a grid: four leaves, the cuts being the pair that gains most."""
    G, H = (np.pad(v.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for v in (g, h))
    a, b = G.shape[0] - 1, G.shape[1] - 1
    if a < 2 or b < 2:
        return np.zeros_like(g), 0.0
    r, c = np.arange(1, a)[:, None], np.arange(1, b)[None, :]

    def quarters(T):
        q = T[r, c]
        return q, T[r, b] - q, T[a, c] - q, T[a, b] - T[r, b] - T[a, c] + q

    qg, qh = quarters(G), quarters(H)
    gain = sum(x * x / (y + ridge) for x, y in zip(qg, qh, strict=True))
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    step = [x[i, j] / (y[i, j] + ridge) for x, y in zip(qg, qh, strict=True)]
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = step
    return out, float(gain[i, j])


def fit(x: np.ndarray, y: np.ndarray, *, max_bins: int = 32, rounds: int = 120, pair_rounds: int = 40, n_pairs: int = 6, rate: float = 0.15, leaves: int = 4, ridge: float = 2.0) -> Model:
    """Without rows the score is one half; with one class, the smoothed share of that class."""
    model = Model(intercept=math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)) if len(y) else 0.0)
    if len(y) == 0 or y.min() == y.max():
        return model
    model.cuts = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, max_bins + 1)[1:-1])) for i in range(x.shape[1])]
    b = model.bins(x)
    sizes = [len(c) + 1 for c in model.cuts]
    model.singles = [np.zeros(s) for s in sizes]
    z = np.full(len(y), model.intercept)

    def residual():
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for i, s in enumerate(sizes):
            g, h = residual()
            step = rate * _tree(np.bincount(b[:, i], g, s), np.bincount(b[:, i], h, s), leaves, ridge)
            model.singles[i] += step
            z += step[b[:, i]]
    grid = {}
    g, h = residual()
    for i, j in combinations(range(len(sizes)), 2):
        at, s = b[:, i] * sizes[j] + b[:, j], sizes[i] * sizes[j]
        grid[i, j] = _grid_tree(np.bincount(at, g, s).reshape(sizes[i], sizes[j]), np.bincount(at, h, s).reshape(sizes[i], sizes[j]), ridge)[1]
    chosen = sorted(grid, key=lambda k: (-grid[k], k))[:n_pairs]
    model.pairs = {k: np.zeros((sizes[k[0]], sizes[k[1]])) for k in chosen}
    for _ in range(pair_rounds):
        for i, j in chosen:
            g, h = residual()
            at, s = b[:, i] * sizes[j] + b[:, j], sizes[i] * sizes[j]
            step = rate * _grid_tree(np.bincount(at, g, s).reshape(sizes[i], sizes[j]), np.bincount(at, h, s).reshape(sizes[i], sizes[j]), ridge)[0]
            model.pairs[i, j] += step
            z += step[b[:, i], b[:, j]]
    return model


def held_out(doc_id) -> F.Column:
    """Rows that labels may not be learned from; a null id has no labels."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _features_of(batch_text, rows: int) -> np.ndarray:
    return np.array([featurize(batch_text[i].as_py()) for i in range(rows)], dtype=np.float64).reshape(rows, len(FEATURES))


def _measure(batches):
    for batch in batches:
        x = _features_of(batch.column(1), batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64())), batch.column(2)], ["doc_id", "x", "quality"])


def train(docs: DataFrame, labels: DataFrame, *, sample_rows: int = 20_000, **how) -> Model:
    """Fit on the sample_rows labelled training rows of smallest hash: a bound on what reaches the driver.

    An id with both labels teaches nothing; nor does one whose remainder holds it out.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other")
    sample = known.select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id").select("doc_id", "text", "quality")
    measured = rows.mapInArrow(_measure, "doc_id long, x array<double>, quality int")
    got = measured.groupBy("doc_id").agg(F.min("x").alias("x"), F.min("quality").alias("quality")).toArrow().sort_by("doc_id")
    if not got.num_rows:
        return Model()
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(got.num_rows, len(FEATURES))
    return fit(x, got.column("quality").to_numpy().astype(np.float64), **how)


def _score(model: Model, text_at: int, names: list[str]):
    def run(batches):
        for batch in batches:
            s = model.score(_features_of(batch.column(text_at), batch.num_rows))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())], names)

    return run


def add_score(docs: DataFrame, model: Model, name: str = "quality_score") -> DataFrame:
    """docs with a score column of the given name, which must not be there yet; text is read whole."""
    docs = docs.withColumn("text", F.col("text").cast("string"))
    at = docs.columns.index("text")
    fields = ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields), f"{name} double"])
    return docs.mapInArrow(_score(model, at, [*docs.columns, name]), fields)


def score_quality(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, **how) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each row of docs.

    Repeated rows give repeated results, null ids are scored like others, a null text counts as empty (all
    figures zero). Only doc_id and text are read. An empty table gives no rows; without labels every score is 0.5.
    """
    model = train(docs, labels, **how)
    out = add_score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")), model, "score")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
