"""Edit-aware token counts: segment trees of pre-tokens, kept as a table and re-encoded only where edits reach.

The pre-token pattern reads a text from left to right and decides each piece from its start and one character
beyond its end. So after an edit, reading anew from a boundary two characters before it gives the same pieces
as a full pass, and from the first boundary that the old text also had, all further pieces stand. A leaf is a run
of pre-tokens; it and every inner node hold sums of characters, pieces and tokens. build_trees reads a corpus
once and gives a row of sums for each text; apply_edits finds the leaves that an edit touches along paths of the
tree, reads these and what follows up to the next leaf that begins as before, and brings the sums above up to
date. Nothing else of a text is tokenised or encoded again, and the new rows can be stored and edited in turn.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.storage import saved_table
from corpusloom.llm.tokenization import default_vocabulary, encoder

TREES = "doc_id long, version int, text string, n_leaves int, chars array<int>, pieces array<int>, tokens array<int>"
#: Sums that each node of a tree holds, in this order.
CHARS, PIECES, TOKENS = range(3)
SCHEMA = "doc_id long, n_pretokens long, n_tokens long, n_edits long, n_tokens_edited long, n_reencoded long, n_chars_edited long"


class PieceCounts(dict):
    """Tokens of a pre-token, remembered; forgotten all at once when `most` are held."""

    def __init__(self, path: str, most: int = 500_000):
        super().__init__()
        self.engine, self.most = encoder(path).fast, most

    def __missing__(self, piece: str) -> int:
        if len(self) >= self.most:
            self.clear()
        n = self[piece] = len(self.engine.encode_ordinary(piece))
        return n


@functools.lru_cache(maxsize=2)
def piece_counts(path: str) -> PieceCounts:
    return PieceCounts(path)


@functools.lru_cache(maxsize=2)
def pieces_pattern(path: str) -> regex.Pattern:
    return regex.compile(encoder(path).pattern)


class TokenTree:
    """Sums over leaves of about `width` pre-tokens each, in heap order: node 1 is the root, 2k and 2k + 1 are below k."""

    def __init__(self, text: str, path: str, n_leaves: int, sums: np.ndarray, width: int):
        self.path, self.width, self.pattern, self.counts = path, width, pieces_pattern(path), piece_counts(path)
        self.n_leaves, self.sums, self.reencoded = n_leaves, sums, 0
        self.base = text
        self.begins = np.concatenate([[0], np.cumsum(self._leaves()[:, CHARS])])
        self.own: dict[int, str] = {}  # texts of the leaves that edits have changed

    @classmethod
    def build(cls, text: str, path: str, width: int = 16) -> TokenTree:
        return cls(text, path, *_planted(*_measured(text, path, width)), width)

    def _leaves(self) -> np.ndarray:
        size = len(self.sums) // 2
        return self.sums[size : size + self.n_leaves]

    def _text_of(self, leaf: int) -> str:
        held = self.own.get(leaf)
        return held if held is not None else self.base[self.begins[leaf] : self.begins[leaf + 1]]

    @property
    def text(self) -> str:
        return "".join(map(self._text_of, range(self.n_leaves))) if self.own else self.base

    @property
    def n_chars(self) -> int:
        return int(self.sums[1, CHARS])

    @property
    def n_tokens(self) -> int:
        return int(self.sums[1, TOKENS])

    @property
    def n_pieces(self) -> int:
        return int(self.sums[1, PIECES])

    def leaf_at(self, place: int) -> tuple[int, int]:
        """(leaf, first character of it) for the leaf that holds the character at place; the last one beyond."""
        size, k, before = len(self.sums) // 2, 1, 0
        while k < size:
            left = int(self.sums[2 * k, CHARS])
            k, before = (2 * k, before) if place < before + left else (2 * k + 1, before + left)
        last = size + self.n_leaves - 1
        return (k - size, before) if k <= last else (self.n_leaves - 1, self.n_chars - int(self.sums[last, CHARS]))

    def edit(self, start: int, length: int, text: str) -> None:
        """Replace `length` characters at `start`; both are cut to the text."""
        start = max(0, min(start, self.n_chars))
        end = min(self.n_chars, start + max(0, length))
        first, at = self.leaf_at(max(0, start - 2))
        last, last_at = self.leaf_at(end)
        last_at += int(self._leaves()[last, CHARS])  # where the leaf after the last one begins
        old = "".join(map(self._text_of, range(first, last + 1)))
        new = old[: start - at] + text + old[end - at :]
        fixed, shift = start - at + len(text), len(new) - len(old)  # what follows `fixed` is old text, moved by shift
        pieces: list[str] = []
        place, ends, after = 0, {}, last + 1
        while True:
            ends = {last_at - at + shift: after} if last_at - at + shift >= fixed else {}
            ahead, more, k = new, [], after  # some leaves of old text beyond, so that a piece's end is seen
            while k < self.n_leaves and sum(map(len, more)) < 64:
                more.append(self._text_of(k))
                k += 1
            ahead = new + "".join(more)
            whole = k == self.n_leaves
            bound = len(new)
            for j in range(after, k):
                bound += len(more[j - after])
                ends[bound] = j + 1
            pieces, place, met = [], 0, None
            for m in self.pattern.finditer(ahead):
                if not whole and m.end() >= len(ahead) - 1:
                    break
                pieces.append(m[0])
                place = m.end()
                if place >= fixed and place in ends:
                    met = ends[place]
                    break
            if met is not None or (whole and place == len(ahead)):
                after = met if met is not None else self.n_leaves
                break
            new, last_at, after = ahead, last_at + sum(map(len, more)), k
        self.reencoded += len(pieces)
        self._put(first, after, pieces)

    def _put(self, first: int, after: int, pieces: list[str]) -> None:
        """New pieces in the place of some leaves, whose number stays; only the sums above them change."""
        size, slots = len(self.sums) // 2, after - first
        cut = [len(pieces) * k // slots for k in range(slots + 1)]
        for k in range(slots):
            part = pieces[cut[k] : cut[k + 1]]
            self.own[first + k] = "".join(part)
            self.sums[size + first + k] = sum(map(len, part)), len(part), sum(map(self.counts.__getitem__, part))
        touched = {(size + k) >> 1 for k in range(first, after)}
        while touched and 0 not in touched:
            for k in touched:
                self.sums[k] = self.sums[2 * k] + self.sums[2 * k + 1]
            touched = {k >> 1 for k in touched}
        if max(b - a for a, b in zip(cut, cut[1:], strict=False)) > 8 * self.width:
            self._replant(first, after, pieces, cut)

    def _replant(self, first: int, after: int, pieces: list[str], cut: list[int]) -> None:
        """A leaf that has grown becomes several; the sums of all others are kept."""
        sizes = np.array([(len(p), 1, self.counts[p]) for p in pieces], dtype=np.int64)
        fresh = np.add.reduceat(sizes, np.arange(0, len(pieces), self.width), axis=0)
        leaves, text = self._leaves(), self.text
        self.n_leaves, self.sums = _planted(np.concatenate([leaves[:first], fresh, leaves[after:]]))
        self.base, self.own = text, {}
        self.begins = np.concatenate([[0], np.cumsum(self._leaves()[:, CHARS])])


def _measured(text: str, path: str, width: int) -> tuple[np.ndarray]:
    """Characters, pieces and tokens of the leaves of a text."""
    pieces = pieces_pattern(path).findall(text)
    if not pieces:
        return (np.zeros((1, 3), dtype=np.int64),)
    n, counts = len(pieces), piece_counts(path)
    sizes = np.stack([np.fromiter(map(len, pieces), dtype=np.int64, count=n), np.ones(n, dtype=np.int64), np.fromiter(map(counts.__getitem__, pieces), dtype=np.int64, count=n)], axis=1)
    return (np.add.reduceat(sizes, np.arange(0, n, width), axis=0),)


def _planted(leaves: np.ndarray) -> tuple[int, np.ndarray]:
    """(number of leaves, sums of a tree over them)."""
    n = max(1, len(leaves))
    size = 1 << max(0, (n - 1).bit_length())
    sums = np.zeros((2 * size, 3), dtype=np.int64)
    sums[size : size + len(leaves)] = leaves
    level = size
    while level > 1:
        sums[level // 2 : level] = sums[level : 2 * level].reshape(level // 2, 2, 3).sum(axis=1)
        level //= 2
    return n, sums


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*rows, np.zeros(0)]).astype(np.int32)))


def _stored(trees: list[TokenTree]) -> list[pa.Array]:
    """The columns n_leaves, chars, pieces, tokens."""
    return [pa.array([t.n_leaves for t in trees], pa.int32()), *(_lists([t.sums[:, c] for t in trees]) for c in (CHARS, PIECES, TOKENS))]


def _built(path: str, width: int, names: list[str], text_at: int):
    def run(batches):
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            trees = [TokenTree.build(t or "", path, width) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, *_stored(trees)], names)

    return run


def build_trees(docs: DataFrame, *, vocabulary: str | None = None, width: int = 16) -> DataFrame:
    """TREES rows, version 0: the sums of a segment tree over the pre-tokens of each row of docs (doc_id, text), and
    `edits` where docs has that column, for edits that are known already.

    A null text stays null, and its tree is that of an empty one. Repeated rows and null ids give a tree each. The
    strings of special tokens are ordinary text. Other columns are not read. An empty table gives no rows.
    """
    extra = [_edits(F.col("edits")).alias("edits")] if "edits" in docs.columns else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).alias("version"), *extra, F.col("text").cast("string").alias("text"))
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields] + ["n_leaves int", "chars array<int>", "pieces array<int>", "tokens array<int>"]
    return rows.mapInArrow(_built(vocabulary or default_vocabulary(), width, [f.split()[0] for f in fields], len(rows.columns) - 1), ", ".join(fields))


def _edits(edits: F.Column) -> F.Column:
    return F.transform(edits, lambda e: F.when(e.isNotNull(), F.struct(e["start"].cast("long").alias("start"), e["length"].cast("long").alias("length"), e["text"].cast("string").alias("text"))))


EDITED = f"{TREES}, n_edits long, n_reencoded long"


def _edited(path: str, width: int):
    """Rows of trees with edits: the new trees."""

    def run(batches):
        names = [f.split()[0] for f in EDITED.split(", ")]
        for batch in batches:
            doc_id, version, text, n_leaves, chars, pieces, tokens, edits = batch.columns
            held = [(c.offsets.to_numpy(), c.values.to_numpy()) for c in (chars, pieces, tokens)]
            trees, done = [], []
            for i in range(batch.num_rows):
                sums = np.stack([v[o[i] : o[i + 1]] for o, v in held], axis=1).astype(np.int64)
                tree, n = TokenTree(text[i].as_py() or "", path, n_leaves[i].as_py(), sums, width), 0
                for e in edits[i].as_py():
                    if e is not None:
                        tree.edit(e["start"] or 0, e["length"] or 0, e["text"] or "")
                        n += 1
                trees.append(tree)
                done.append(n)
            fresh = [doc_id, pa.array([v + 1 for v in version.to_pylist()], pa.int32()), pa.array([t.text for t in trees], pa.string()), *_stored(trees)]
            yield pa.RecordBatch.from_arrays([*fresh, pa.array(done, pa.int64()), pa.array([t.reencoded for t in trees], pa.int64())], names)

    return run


def apply_edits(trees: DataFrame, edits: DataFrame | None = None, *, vocabulary: str | None = None, width: int = 16) -> DataFrame:
    """TREES rows after their edits, with n_edits and n_reencoded (pieces read and encoded anew); versions grow by one.

    edits: (doc_id, edits), one row for an id, joined to all trees of that id; without it, trees carry a column
    `edits`. That is an array of struct (start, length, text), applied in order, places being characters of the text
    as it then stands and cut to it; null fields count as 0 or empty, null edits as none. Trees without edits are
    handed on as they are, null ids among them.
    """
    if edits is not None:
        wanted = edits.select(F.col("doc_id").cast("long").alias("doc_id"), _edits(F.col("edits")).alias("edits"))
        trees = trees.join(wanted, "doc_id", "left")
    names = [f.split()[0] for f in TREES.split(", ")]
    some = F.coalesce(F.size(F.filter("edits", lambda e: e.isNotNull())) > 0, F.lit(False))
    same = trees.where(~some).select(*names, F.lit(0).cast("long").alias("n_edits"), F.lit(0).cast("long").alias("n_reencoded"))
    return trees.where(some).select(*names, "edits").mapInArrow(_edited(vocabulary or default_vocabulary(), width), EDITED).unionByName(same)


def _counted(path: str, width: int):
    """Rows (root sums, tree, edits) of a corpus: the counts before and after, without the new texts."""

    def run(batches):
        edited = _edited(path, width)
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        for batch in batches:
            chars, pieces, tokens, edits = (batch.column(k) for k in range(4, 8))
            filled = pa.array([e if e is not None else [] for e in edits.to_pylist()], edits.type)
            for new in edited([pa.RecordBatch.from_arrays([*batch.columns[:7], filled], batch.schema.names)]):
                root = lambda c: c.values.to_numpy()[c.offsets.to_numpy()[:-1] + 1].astype(np.int64)
                yield pa.RecordBatch.from_arrays([new.column(0), pa.array(root(pieces)), pa.array(root(tokens)), new.column(7), pa.array(root(new.column(6))), new.column(8), pa.array(root(new.column(4)))], names)

    return run


def count_edited(docs: DataFrame, *, vocabulary: str | None = None, width: int = 16) -> DataFrame:
    """Token counts before and after the edits of each row of docs (doc_id, text, edits).

    The corpus is read and encoded once, into a stored table of trees, and the edits are counted from that table.
    edits: array of struct (start, length, text), applied in order, places being characters of the text as it
    then stands. Null and empty texts count as empty, null edits as none, null fields as 0 or empty; places
    beyond the text are cut to it. Each row counts by itself, repeated rows and null ids too. The strings of
    special tokens are ordinary text here. Other columns are not read. An empty table gives no rows.
    """
    path = vocabulary or default_vocabulary()
    trees = saved_table(build_trees(docs, vocabulary=path, width=width))
    return trees.select(*[f.split()[0] for f in TREES.split(", ")], "edits").mapInArrow(_counted(path, width), SCHEMA)


def sample_edits(docs: DataFrame, n: int = 4) -> DataFrame:
    """doc_id, text and n edits for each row, fixed by its id: words put in, taken out and exchanged all over the text."""
    words = F.array(*[F.lit(w) for w in (" revised", "", "2024", " the new\n", "'s", "  ", "naïve", "…")])
    size = F.greatest(F.length(F.coalesce("text", F.lit(""))), F.lit(1))

    def one(k: int):
        h = lambda salt: F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), F.lit(k), F.lit(salt))
        return F.struct(F.pmod(h(1), size).alias("start"), F.pmod(h(2), F.lit(12)).alias("length"), F.element_at(words, (F.pmod(h(3), F.lit(8)) + 1).cast("int")).alias("text"))

    return docs.select("doc_id", "text", F.array(*[one(k) for k in range(n)]).alias("edits"))
