"""How far the sources of a language diverge in their words: a baseline-correction inverted index.

Smoothed shares of two sources differ for every term that the language keeps, but for most terms both counts are
zero. So each pair of sources starts at V times the difference of their shares of a zero count, and the inverted
index only adds what other counts change: terms that one source has, by its histogram of shares against the other's
zero share, and terms that both have, from the term's postings. Postings meet in square tiles of sources, summed in
place, so no row is made for a pair within a term.

Terms are counted where the texts lie, in tables of a bounded size, before anything is shuffled; what is shuffled
is a count for each source and term, never a text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.storage import saved_table

#: What stands in no term, and the scale of shares.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UNITS = 1_000_000_000
#: ASCII letters in lower case, bytes of other characters as they are, all else a space.
_TERMS = bytes(c if c >= 0x80 or 0x61 <= c <= 0x7A else c + 0x20 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
COUNTED = "lang string, source string, term string, occurrences long, docs long"


def _pieces(text: bytes, most: int) -> Iterator[list[bytes]]:
    """The terms of a text, piece by piece; no piece ends within a term."""
    text = text.translate(_TERMS)
    at = 0
    while at < len(text):
        end = text.find(b" ", at + most)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def _count(held: int, piece: int):
    """Batches of (lang, source, text) to counts of COUNTED, given out whenever `held` different ones are there."""

    def flush(counts, docs):
        rows = [(*g, t, n, docs[g][t]) for g, found in counts.items() for t, n in found.items()]
        for i in range(0, len(rows), 1 << 16):
            cols = zip(*rows[i : i + (1 << 16)], strict=True)
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [f.split()[0] for f in COUNTED.split(", ")])

    def run(batches):
        counts, docs, new = {}, {}, 0
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                g = (lang, source)
                found, inside, own = counts.setdefault(g, Counter()), docs.setdefault(g, Counter()), set()
                before = len(found)
                for terms in _pieces(text.as_buffer().to_pybytes(), piece):
                    found.update(terms)
                    own.update(terms)
                inside.update(own)
                new += len(found) - before
                if new >= held:
                    yield from flush(counts, docs)
                    counts, docs, new = {}, {}, 0
        yield from flush(counts, docs)

    return run


def term_counts(docs: DataFrame, *, held: int = 200_000, piece: int = 1 << 20) -> DataFrame:
    """lang, source, term, occurrences, docs (how many documents have the term): one row for each of them, dealt by
    lang and term. Null texts, langs and sources count as empty."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(text("lang").alias("lang"), text("source").alias("source"), text("text").alias("text"))
    dealt = rows.mapInArrow(_count(held, piece), COUNTED).repartition("lang", "term")
    return dealt.groupBy("lang", "source", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("docs").alias("docs"))


def share(count: str, total: str, kept: str, smoothing: int) -> Column:
    """1 + floor(UNITS * (count + smoothing) / (total + smoothing * kept)), exactly; null where nothing is kept."""
    whole = "CAST({} AS DECIMAL(28, 0))".format
    return F.expr(f"1 + {whole(f'{count} + {smoothing}')} * CAST({UNITS} AS DECIMAL(10, 0)) DIV nullif({whole(f'{total} + {kept} * {smoothing}')}, 0)")


TILE = "lang string, a long, b long, correction long"


def _tiles(side: int):
    """Postings (lang, i, j, part, term, src, p, p0), together and in order of term for each (lang, i, j, part): for
    each pair of sources of tiles i and j, what the terms that both have add to the one-sided corrections."""

    def give(group, total):
        lang, i, j, _ = group
        a, b = np.nonzero(total)
        cols = (pa.array([lang] * len(a), pa.string()), pa.array(a + i * side), pa.array(b + j * side), pa.array(total[a, b]))
        return pa.RecordBatch.from_arrays(list(cols), [f.split()[0] for f in TILE.split(", ")])

    def add(group, total, src, p, p0):
        i, j = group[1:3]
        one, two = src // side == i, src // side == j
        a, b = src[one] - i * side, src[two] - j * side
        pa_, pb, za, zb = p[one][:, None], p[two][None, :], p0[one][:, None], p0[two][None, :]
        gain = np.abs(pa_ - pb) - np.abs(pa_ - zb) - np.abs(za - pb) + np.abs(za - zb)
        total[np.ix_(a, b)] += gain if i != j else np.where(a[:, None] < b[None, :], gain, 0)

    def run(batches):
        group, term, held, total = None, None, [], None
        for batch in batches:
            lang, i, j, part, terms = (batch.column(k) for k in range(5))
            numbers = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in (5, 6, 7)])
            keys = list(zip(lang.to_pylist(), i.to_pylist(), j.to_pylist(), part.to_pylist(), terms.to_pylist(), strict=True))
            starts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
            for a, b in zip(starts, starts[1:], strict=False):
                if a == b:
                    continue
                if (group, term) != (keys[a][:4], keys[a][4]):
                    if held:
                        add(group, total, *np.concatenate(held, axis=1))
                    held = []
                    if group != keys[a][:4]:
                        if group is not None:
                            yield give(group, total)
                        group, total = keys[a][:4], np.zeros((side, side), dtype=np.int64)
                    term = keys[a][4]
                held.append(numbers[:, a:b])
        if group is not None:
            add(group, total, *np.concatenate(held, axis=1))
            yield give(group, total)

    return run


def audit_sources(docs: DataFrame, *, least_docs: int = 30, smoothing: int = 5, top_terms: int = 50, side: int = 256, rows_a_task: int = 4096) -> DataFrame:
    """lang, source, part, item, value, rank for each lang and source of docs.

    Part pair: item is another source of the lang, value how far their shares lie apart, summed over the terms that
    stand in least_docs of the lang's documents or more (0 without such terms). Part term: item is a term of the
    source whose share exceeds that in the lang, value by how much, the top_terms largest only. Ranks go by falling
    value, then by item as UTF-8.

    Null texts, langs and sources count as empty; a source without terms has its pairs. Repeated rows count each
    time. Other columns, doc_id too, are not read and may have any name; an empty table gives no rows. Very long
    texts are counted piece by piece.
    """
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    groups = docs.select(known("lang").alias("lang"), known("source").alias("source")).distinct()
    term = Window.partitionBy("lang", "term")
    counted = term_counts(docs).withColumns({"in_docs": F.sum("docs").over(term), "everywhere": F.sum("occurrences").over(term), "head": F.row_number().over(term.orderBy("source")) == 1})
    posts = saved_table(counted.where(F.col("in_docs") >= least_docs).select("lang", "source", "term", "occurrences", "everywhere", "head"))
    of_source = posts.groupBy("lang", "source").agg(F.sum("occurrences").alias("total"), F.sum(F.col("head").cast("long")).alias("heads"))
    of_lang = of_source.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("heads").alias("kept"))
    sized = groups.join(of_source.drop("heads"), ["lang", "source"], "left").join(of_lang, "lang", "left").fillna(0, ["total", "lang_total", "kept"])
    facts = saved_table(sized.withColumns({"src": F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1, "p0": share("0", "total", "kept", smoothing)}))
    shares = posts.join(facts, ["lang", "source"]).withColumn("p", share("occurrences", "total", "kept", smoothing))

    over = shares.withColumn("value", F.col("p") - share("everywhere", "lang_total", "kept", smoothing)).where("value > 0")
    ordered = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = over.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value").withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= top_terms)

    other = facts.select("lang", F.col("src").alias("o"), F.col("source").alias("other"), F.col("p0").alias("q0"))
    baseline = facts.join(other, "lang").where("src < o").select("lang", F.col("src").alias("a"), F.col("o").alias("b"), "source", "other", F.coalesce(F.col("kept") * F.abs(F.col("p0") - F.col("q0")), F.lit(0)).alias("correction"))
    alike = shares.groupBy("lang", "src", "p0", "p").agg(F.count("*").alias("n"))
    gain = F.abs(F.col("p") - F.col("q0")) - F.abs(F.col("p0") - F.col("q0"))
    one_sided = alike.join(other, "lang").where("src <> o").groupBy("lang", F.least("src", "o").alias("a"), F.greatest("src", "o").alias("b")).agg(F.sum(F.col("n") * gain).alias("correction"))
    # Tasks of rows_a_task postings at least, and of as many as the pairs that a tile may give.
    sizes = facts.groupBy("lang").agg(F.max("src").alias("last")).join(posts.groupBy("lang").agg(F.count("*").alias("rows")), "lang")
    pairs_a_tile = F.pow(F.least(F.col("last") + 1, F.lit(side)), F.lit(2)) / 2
    tiles = sizes.select("lang", (F.col("last") / side).cast("long").alias("last_tile"), F.ceil(F.col("rows") / F.greatest(F.lit(float(rows_a_task)), pairs_a_tile)).cast("long").alias("parts"))
    tile, o = (F.col("src") / side).cast("long"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("last_tile")))
    dealt = shares.join(tiles, "lang").select("lang", "term", "src", "p", "p0", tile.alias("tile"), o.alias("o"), F.pmod(F.xxhash64("term"), F.col("parts")).alias("part"))
    where = ["lang", "i", "j", "part"]
    met = dealt.select("lang", F.least("tile", "o").alias("i"), F.greatest("tile", "o").alias("j"), "part", "term", "src", "p", "p0").repartition(*where).sortWithinPartitions(*where, "term")
    both = met.mapInArrow(_tiles(side), TILE)

    named = lambda c: c.withColumns({"source": F.lit(None).cast("string"), "other": F.lit(None).cast("string")})
    apart = baseline.unionByName(named(one_sided)).unionByName(named(both)).groupBy("lang", "a", "b").agg(F.max("source").alias("source"), F.max("other").alias("other"), F.sum("correction").alias("value"))
    ways = F.explode(F.array(F.struct("source", F.col("other").alias("item")), F.struct(F.col("other").alias("source"), F.col("source").alias("item"))))
    pairs = apart.select("lang", ways.alias("way"), "value").select("lang", "way.source", F.lit("pair").alias("part"), "way.item", "value").withColumn("rank", F.row_number().over(ordered))
    return terms.unionByName(pairs)


def oracle() -> str:
    """The same in DuckDB's SQL: every group of a lang with every kept term, every pair term by term."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '{TERM}') AS words FROM documents),
w AS (SELECT rid, lang, source, unnest(words) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT rid) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
f AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS m, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total, count(*) OVER (PARTITION BY g.lang, g.source) AS v, sum(k.n) OVER (PARTITION BY g.lang, g.source) AS lang_total
      FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT lang, source, term, n, CAST(1 + (1000000000 * CAST(n + 5 AS HUGEINT)) // CAST(total + 5 * v AS HUGEINT) AS BIGINT) AS p, CAST(1 + (1000000000 * CAST(m + 5 AS HUGEINT)) // CAST(lang_total + 5 * v AS HUGEINT) AS BIGINT) AS q FROM f),
x AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(x.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
      UNION ALL SELECT lang, source, 'term', term, p - q FROM s WHERE n > 0 AND p > q),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= 50"""
