"""Document structure: hierarchical chunks from numbered lines, links between them, audits."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNKS = "doc_id long, chunk_id string, parent_chunk_id string, chunk_level string, chunk_type string, chunk_order long, label string, content string"
REFERENCE = r"(?i)\b(table|figure|fig\.|section|article)\s+(\d+(?:\.\d+)*)"


@dataclass(frozen=True)
class Grammar:
    """Patterns of the levels from the top down; a pattern's group 1 is the label. Lines of no level are content.

    front: lines up to this pattern are left out; drop: running heads and the like; restart: levels whose labels
    begin anew under each of their parents, so the parent's label goes into the id.
    """

    name: str
    levels: tuple[tuple[str, str], ...]
    front: str | None = None
    drop: str | None = None


# The numbering styles of seven families of rule books.
GRAMMARS = {
    "kr": Grammar("kr", (("part", r"^제\s*(\d+)\s*편"), ("chapter", r"^제\s*(\d+)\s*장"), ("section", r"^제\s*(\d+)\s*절"), ("article", r"^(\d{3,4})\.\s"), ("paragraph", r"^(\d{1,2})\.\s"), ("item", r"^\((\d{1,2})\)\s"), ("subitem", r"^\(([가-힣])\)\s")), drop=r"^\d+$|·{5,}|\.{5,}"),
    "nk": Grammar("nk", (("chapter", r"^Chapter\s+(\d+)"), ("section", r"^([A-Z]?\d+\.\d+)\s"), ("article", r"^([A-Z]?\d+\.\d+\.\d+)\*?\s")), drop=r"\.{5,}"),
    "lr": Grammar("lr", (("chapter", r"^Chapter\s+(\d+)"), ("article", r"^(\d+\.\d+)\s"), ("paragraph", r"^(\d+\.\d+\.\d+)\s"))),
    "dnv": Grammar("dnv", (("section", r"^SECTION\s+(\d+)"), ("article", r"^(\d+)\s"), ("paragraph", r"^(\d+\.\d+)\s"), ("item", r"^(\d+\.\d+\.\d+)\s")), front=r"^SECTION\s+1\b"),
    "bv": Grammar("bv", (("part", r"^Part\s+([A-Z0-9]+)"), ("chapter", r"^Chapter\s+(\d+)"), ("section", r"^Section\s+(\d+)"), ("article", r"^\[?(\d+)\]?\s"), ("paragraph", r"^\[?(\d+\.\d+)\]?\s"))),
    "iacs": Grammar("iacs", (("article", r"^([A-Z]?\d+)\.?\s|^(?:Regulation)\s+(\d+)"), ("paragraph", r"^([A-Z]?\d+\.\d+)\s|^(?:Paragraph)\s+(\d+)")), drop=r"^(?:19|20)\d{2}$"),
    "abs": Grammar("abs", (("section", r"^(?:SECTION|APPENDIX)\s+(\d+|[A-Z])"), ("article", r"^(\d+)\s"), ("paragraph", r"^(\d+\.\d+)\s"), ("item", r"^(\d+\.\d+\.\d+)\s"))),
    "plain": Grammar("plain", (("section", r"^(#{1,2}\s.*|[^\s].{0,60}:)$"), ("article", r"^(\d+)[.)]\s"), ("item", r"^[-*]\s+(\S+)"))),
}
# Marks by which a family is known, in order.
SIGNATURES = (("kr", r"제\s*\d+\s*편|제\s*\d+\s*장"), ("dnv", r"(?m)^SECTION\s+\d+"), ("abs", r"(?m)^APPENDIX\s"), ("bv", r"(?m)^Part\s+[A-Z0-9]+\s*$"), ("lr", r"(?m)^Chapter\s+\d+[\s\S]*^\d+\.\d+\.\d+\s"), ("nk", r"(?m)^Chapter\s+\d+"), ("iacs", r"(?m)^Regulation\s+\d+"))


def family(text: Column) -> Column:
    """The first family whose marks a text shows; many Hangul letters make it kr; plain otherwise."""
    out = F.when(text.rlike(SIGNATURES[0][1]), SIGNATURES[0][0])
    for name, pattern in SIGNATURES[1:]:
        out = out.when(text.rlike(pattern), name)
    return out.when(F.regexp_count(text, F.lit("[가-힣]")) > 200, "kr").otherwise("plain")


def parse(doc_id, text: str | None, grammar: Grammar) -> Iterator[tuple]:
    """Chunks of one document: a stack of open levels; content goes to the innermost."""
    levels = [(name, re.compile(p)) for name, p in grammar.levels]
    drop = re.compile(grammar.drop) if grammar.drop else None
    started = grammar.front is None
    stack: list[tuple[int, str]] = []
    rows: list[list] = []
    seen: dict[str, int] = {}
    for line in (text or "").split("\n"):
        line = line.strip()
        if not line or (drop and drop.search(line)):
            continue
        started = started or bool(re.search(grammar.front or "", line))
        if not started:
            continue
        deepest = None
        for depth in range(len(levels) - 1, -1, -1):  # the longest number is the innermost level that fits
            if m := levels[depth][1].search(line):
                deepest = depth, next((g for g in m.groups() if g), "")
                break
        if deepest is None:
            if rows and stack:
                rows[-1][-1] += ("\n" if rows[-1][-1] else "") + line
            else:
                rows.append([doc_id, f"{doc_id}:intro:{len(rows)}", None, "intro", "text", len(rows), "", line])
            continue
        depth, label = deepest
        while stack and stack[-1][0] >= depth:
            stack.pop()
        parent = stack[-1][1] if stack else None
        base = f"{parent or doc_id}/{levels[depth][0]}:{label}"
        seen[base] = seen.get(base, 0) + 1
        chunk = base if seen[base] == 1 else f"{base}~{seen[base]}"
        stack.append((depth, chunk))
        rows.append([doc_id, chunk, parent, levels[depth][0], "text", len(rows), label, line])
    yield from map(tuple, rows)


def chunk_documents(docs: DataFrame, grammar: str | None = None, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """CHUNKS of each document by a grammar, or by that of its family; documents are parsed where they lie."""
    kinds = F.lit(grammar) if grammar else family(F.col(text))
    names = [f.split()[0] for f in CHUNKS.split(", ")]

    def run(batches):
        for pdf in batches:
            rows = [r for i, t, g in zip(pdf["id"], pdf["text"], pdf["g"], strict=True) for r in parse(i, t, GRAMMARS[g])]
            yield pd.DataFrame(rows, columns=names)

    return docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text"), kinds.alias("g")).mapInPandas(run, CHUNKS)


def link_siblings(chunks: DataFrame) -> DataFrame:
    along = Window.partitionBy("doc_id", F.coalesce("parent_chunk_id", F.lit(""))).orderBy("chunk_order")
    return chunks.withColumn("previous_chunk_id", F.lag("chunk_id").over(along)).withColumn("next_chunk_id", F.lead("chunk_id").over(along))


def references(chunks: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, kind, number, pos) of what each chunk's content cites."""
    found = F.regexp_extract_all("content", F.lit(REFERENCE), F.lit(0))
    rows = chunks.select("doc_id", "chunk_id", F.posexplode(found).alias("pos", "cited"))
    kind = F.regexp_replace(F.lower(F.regexp_extract("cited", REFERENCE, 1)), r"fig\.", "figure")
    return rows.select("doc_id", "chunk_id", kind.alias("kind"), F.regexp_extract("cited", REFERENCE, 2).alias("number"), "pos")


def resolve_references(refs: DataFrame, chunks: DataFrame) -> DataFrame:
    """References to sections and articles of the same document with exactly one target, ordered distinct by chunk."""
    targets = chunks.where("label <> ''").select("doc_id", F.col("chunk_level").alias("kind"), F.col("label").alias("number"), F.col("chunk_id").alias("target"))
    single = targets.groupBy("doc_id", "kind", "number").agg(F.count("*").alias("n"), F.first("target").alias("target")).where("n = 1").drop("n")
    linked = refs.join(single, ["doc_id", "kind", "number"]).where("target <> chunk_id")
    return linked.groupBy("doc_id", "chunk_id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "target"))), lambda x: x["target"])).alias("linked_chunk_ids"))


def chunk_audit(chunks: DataFrame) -> DataFrame:
    """For each document: chunks, repeated ids, median and most children, share of empty content."""
    children = chunks.where("parent_chunk_id IS NOT NULL").groupBy("doc_id", "parent_chunk_id").agg(F.count("*").alias("kids"))
    kids = children.groupBy("doc_id").agg(F.percentile("kids", F.lit(0.5)).alias("kids_median"), F.max("kids").alias("kids_most"))
    base = chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), (F.count("*") - F.count_distinct("chunk_id")).alias("repeated_ids"), F.avg((F.length(F.trim("content")) == 0).cast("double")).alias("empty_share"))
    return base.join(kids, "doc_id", "left").fillna(0, ["kids_median", "kids_most"])


def islands(rows: DataFrame, partition: list[str], order: str, same: list[str]) -> DataFrame:
    """Numbers runs of consecutive rows that agree on `same`."""
    along = Window.partitionBy(*partition).orderBy(order)
    new = F.lit(False)
    for c in same:
        new = new | ~F.lag(c).over(along).eqNullSafe(F.col(c))
    return rows.withColumn("_new", new.cast("int")).withColumn("island", F.sum("_new").over(along)).drop("_new")


def merge_adjacent(rows: DataFrame, partition: list[str], order: str, same: list[str], text: str) -> DataFrame:
    """Runs of rows that agree on `same` become one, their texts joined in order."""
    keyed = islands(rows, partition, order, same)
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return keyed.groupBy(*partition, "island", *same).agg(F.array_join(F.transform(parts, lambda x: x["t"]), " ").alias(text), F.count("*").alias("n_parts"))


def spatial_score(ax: Column, ay: Column, x0: Column, y0: Column, x1: Column, y1: Column, slack: float = 20.0) -> Column:
    """1 where a centre lies in a box widened by slack, else falling with its distance from the box's centre, which is
    scaled by the box's sides, 120 across and 60 down at least."""
    inside = ax.between(x0 - slack, x1 + slack) & ay.between(y0 - slack, y1 + slack)
    dx = F.abs(ax - (x0 + x1) / 2) / F.greatest(x1 - x0, F.lit(120.0))
    dy = F.abs(ay - (y0 + y1) / 2) / F.greatest(y1 - y0, F.lit(60.0))
    return F.when(inside, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - (dx + dy) / 2))
