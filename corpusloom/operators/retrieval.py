"""Exact vector search, ranking, expansion to parents, context budgets, retrieval metrics."""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from corpusloom.functions.text import SPACES, strip_years


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def _dots(q: np.ndarray, x: np.ndarray, qi: np.ndarray, xi: np.ndarray) -> np.ndarray:
    """Inner products of pairs of columns, added up in the order of the components as dot does."""
    out = np.zeros(len(qi))
    for a, b in zip(q, x, strict=True):
        out += a[qi] * b[xi]
    return out


def _first_places(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best rows of each query, ties by id, and their places from 0."""
    order = np.lexsort((np.unique(ids, return_inverse=True)[1] if ids.dtype == object else ids, -score, query))
    place = np.arange(len(order)) - np.searchsorted(query[order], query[order])
    return order[place < k], place[place < k]


#: How many queries and rows of the store make a block of a matrix product.
BLOCK_QUERIES, BLOCK_ROWS = 256, 8192


def _scored(asked, k: int | None, least: float | None):
    """Arrow batches of the store to pairs and their scores. Matrix products find what may count, and that alone is added
    up in order; a task keeps the k best rows of each query."""

    def run(batches):
        query_ids, q = asked.value
        lengths, error = np.sqrt(np.einsum("ij,ij->i", q, q)), 8 * q.shape[1] * np.finfo(float).eps
        columns = np.ascontiguousarray(q.T)
        kth, held = np.full(len(q), -np.inf), {}  # each query's k-th best score, once it has k rows; rows by block
        out = lambda query, ids, score: pa.RecordBatch.from_arrays([query_ids.take(pa.array(query)), pa.array(ids, type=kind), pa.array(score)], names=["query_id", "vec_id", "score"])
        for batch in (b.slice(start, BLOCK_ROWS) for b in batches for start in range(0, b.num_rows, BLOCK_ROWS)):
            kind, ids = batch.column(0).type, batch.column(0).to_numpy(zero_copy_only=False)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, q.shape[1])
            across, longest = np.ascontiguousarray(x.T), np.sqrt(np.einsum("ij,ij->i", x, x).max())
            for b in range(0, len(q), BLOCK_QUERIES):
                block = slice(b, b + BLOCK_QUERIES)
                near, slack = q[block] @ across, lengths[block] * longest * error
                cut = np.full(len(near), -np.inf if least is None else least)
                if k is not None:
                    cut = np.maximum(cut, kth[block])
                    if len(x) > k and np.isneginf(kth[block]).any():
                        cut = np.maximum(cut, np.partition(near, len(x) - k, axis=1)[:, len(x) - k])
                qi, xi = np.nonzero(near >= (cut - slack)[:, None])
                score = _dots(columns[:, block], across, qi, xi)
                kept = slice(None) if least is None else score >= least
                rows = qi[kept] + b, ids[xi[kept]], score[kept]
                if k is None:
                    yield out(*rows)
                    continue
                rows = [np.concatenate(v) for v in zip(held[b], rows, strict=True)] if b in held else rows
                first, place = _first_places(*rows, k)
                query, _, score = held[b] = [v[first] for v in rows]
                kth[query[place == k - 1]] = score[place == k - 1]
        for rows in held.values():
            yield out(*rows)

    return run


def search(store: DataFrame, queries: DataFrame, k: int | None, least: float | None = None, by: list[str] | None = None, most_queries: int = 20_000) -> DataFrame:
    """(query_id, vec_id, score, rank): the k best vectors of each query, ties by id; without k all of them, without ranks.

    queries (query_id, vector) is a stated set. It is counted and sent to all tasks in blocks of most_queries rows or so,
    each met by all of the store in matrix products; with by, columns on which both sides must agree, the sides are
    joined instead. Each task sends k rows for a query at most. Vectors that are null, hold null, non-finite or huge
    components, or differ in length from most queries' are scored by the expression.
    """
    sc = store.sparkSession.sparkContext
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, vec_id {store.schema['vec_id'].dataType.simpleString()}, score double"
    usual_ = lambda v, i: i.isNotNull() & F.coalesce(F.forall(v, lambda c: c.isNotNull() & F.coalesce(F.abs(c) < 1e100, F.lit(False))), F.lit(False))

    def plainly(s: DataFrame, q: DataFrame) -> DataFrame:
        s, q = s.alias("s"), q.alias("q")
        on = [F.col(f"s.{c}") == F.col(f"q.{c}") for c in by or []]
        scored = (s.join(q, on) if on else s.crossJoin(F.broadcast(q))).select("query_id", "vec_id", dot(F.col("embedding"), F.col("vector")).alias("score"))
        return scored if least is None else scored.where(F.col("score") >= least)

    def met(asked: DataFrame) -> list[DataFrame]:
        told = asked.withColumn("dims of search", F.when(usual_(F.col("vector"), F.col("query_id")), F.size("vector")).otherwise(0))
        sizes = {r["dims of search"]: r["n"] for r in told.groupBy("dims of search").agg(F.count("*").alias("n")).collect()}
        dims = max(sizes, key=lambda d: (d > 0, sizes[d], d), default=0)
        if dims <= 0:
            return [plainly(store, asked)]
        sent = told.where(F.col("dims of search") == dims).select("query_id", F.col("vector").cast("array<double>")).toArrow().combine_chunks()
        ids, vectors = (c.chunk(0) if c.num_chunks == 1 else c.combine_chunks() for c in sent.columns)
        asked_ = sc.broadcast((ids, vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)))
        usual = F.coalesce(usual_(F.col("embedding"), F.col("vec_id")) & (F.size("embedding") == dims), F.lit(False))
        dealt = store.where(usual).select("vec_id", F.col("embedding").cast("array<double>").alias("v")).repartition(2 * sc.defaultParallelism)
        out = [dealt.mapInArrow(_scored(asked_, k, least), kinds), plainly(store.where(~usual), asked)]
        others = told.where(F.col("dims of search") != dims).drop("dims of search")
        return out if len(sizes) == 1 else [*out, plainly(store.where(usual), others)]

    if by:
        scored = plainly(store, queries)
    else:
        blocks = max(1, -(-queries.count() // most_queries))
        parts = [queries] if blocks == 1 else [queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) for b in range(blocks)]
        scored = functools.reduce(DataFrame.unionByName, [rows for part in parts for rows in met(part)])
    if k is None:
        return scored
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)


def rerank(hits: DataFrame, score: Column, k: int) -> DataFrame:
    """The k best hits of each query by another score; where it is null, by rank. Queries of k hits or fewer keep their order."""
    own = Window.partitionBy("query_id")
    many = F.count("*").over(own) > k
    order = own.orderBy(F.desc_nulls_last(F.when(F.col("many of rerank"), F.col("score of rerank"))), "rank")
    scored = hits.withColumn("many of rerank", many).withColumn("score of rerank", score)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("many of rerank", "score of rerank")


def retrieve(store: DataFrame, queries: DataFrame, k: int = 4, least: float = 0.3, over: int = 20, rescore: Column | None = None, path: str | None = "section_path") -> DataFrame:
    """Hits of each query in stages: more than k where they are scored anew, a threshold (0: none), one edition of each
    section, the new score, and the k best; with the store's columns."""
    found = search(store, queries, max(k, over) if rescore is not None else k)
    hits = (found.where(F.col("score") >= least) if least > 0 else found).join(store.drop("embedding"), "vec_id")
    if path is not None:
        hits = dedup_editions(hits, path)
    if rescore is not None:
        return rerank(hits, rescore, k)
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)


def low_confidence(hits: DataFrame, queries: DataFrame, least: float = 0.38) -> DataFrame:
    """(query_id, low): queries without hits, or whose best score is below least."""
    best = hits.groupBy("query_id").agg(F.max("score").alias("best"))
    return queries.select("query_id").join(best, "query_id", "left").select("query_id", (F.coalesce("best", F.lit(-1.0)) < least).alias("low"))


def retrieval_metrics(ranks: DataFrame, ks=(1, 3, 5, 10), by: list[str] | None = None) -> DataFrame:
    """recall@k and MRR from (query, rank of the first relevant hit or null)."""
    return ranks.groupBy(*(by or [])).agg(F.count("*").alias("n"), *[F.round(F.avg(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))), 4).alias(f"recall_{k}") for k in ks], F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 4).alias("mrr"))


def dedup_editions(hits: DataFrame, path: str = "section_path") -> DataFrame:
    """The best hit of each query and section, editions by year falling together."""
    first = Window.partitionBy("query_id", strip_years(F.col(path))).orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


def hydrate_parents(children: DataFrame, parents: DataFrame, parent_id: str, content: str, most_chars: int = 4000) -> DataFrame:
    """Children with their parents' content cut to most_chars; a child without a parent's content goes."""
    held = parents.select(parent_id, F.substring(F.col(content), 1, most_chars).alias("parent_content")).where("coalesce(parent_content, '') <> ''")
    return children.join(held, parent_id)


def collapse_parents(hits: DataFrame, parent: str, own: str, score: str = "score", by: list[str] | None = None) -> DataFrame:
    """One row for each parent in rank order; a child without a parent stands for itself."""
    first = Window.partitionBy(*(by or []), F.coalesce(F.col(parent), F.col(own))).orderBy(F.desc(score), own)
    return hits.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


def capped_concat(rows: DataFrame, key: str, order: str, text: str, most_chars: int, marker: str = "[cut]", separator: str = "\n") -> DataFrame:
    """Each key's texts in order up to a running budget; the text that would pass it gives way to a marker."""
    running = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first_over = Window.partitionBy(key).orderBy(order)
    counted = rows.select(key, order, F.col(text).alias("_t"), F.sum(F.length(text)).over(running).alias("_sum"))
    over = counted.withColumn("_over", (F.col("_sum") > most_chars).cast("int")).withColumn("_n", F.sum("_over").over(first_over))
    kept = over.where("_n <= 1").withColumn("_t", F.when(F.col("_over") == 1, marker).otherwise(F.col("_t")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("_t").alias("t")))), lambda x: x["t"]), separator)
    return kept.groupBy(key).agg(joined.alias("context"), F.count_if(F.col("_over") == 0).alias("n_kept"), F.bool_or(F.col("_over") == 1).alias("cut"))


def allocate_context(hits: DataFrame, budget: int, content: str = "content") -> DataFrame:
    """Characters for each ranked hit: an equal base, and what short ones leave goes on by rank.

    A hit's share is known from the needs of those before it, so a running sum does for the fold: with base b,
    the first r hits may use r times b and what is spare of all.
    """
    base = F.floor(F.lit(budget) / F.count("*").over(Window.partitionBy("query_id")))
    need = F.length(content)
    rows = hits.withColumn("_base", base).withColumn("_spare", F.greatest(F.col("_base") - need, F.lit(0))).withColumn("_want", F.greatest(need - F.col("_base"), F.lit(0)))
    whole = F.sum("_spare").over(Window.partitionBy("query_id")) + F.lit(budget) - F.col("_base") * F.count("*").over(Window.partitionBy("query_id"))
    before = F.coalesce(F.sum("_want").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    extra = F.greatest(F.least(F.col("_want"), whole - before), F.lit(0))
    return rows.withColumn("n_chars", (F.least(need, F.col("_base")) + extra).cast("long")).withColumn("excerpt", F.substr(F.col(content), F.lit(1), F.col("n_chars").cast("int"))).drop("_base", "_spare", "_want")


def text_units(text: Column, size: int = 600) -> Column:
    """Lines gathered to units of about `size` characters: a unit ends before the line that would take it beyond."""
    lines = F.split(text, "\n")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(state: Column, line: Column) -> Column:
        full = (state["now"] != "") & (F.length(state["now"]) + F.length(line) > size)
        return F.struct(F.when(full, F.array_append(state["done"], state["now"])).otherwise(state["done"]).alias("done"), F.when(full | (state["now"] == ""), line).otherwise(F.concat(state["now"], F.lit("\n"), line)).alias("now"))

    return F.aggregate(lines, start, step, lambda s: F.when(s["now"] != "", F.array_append(s["done"], s["now"])).otherwise(s["done"]))


GAP = "…(중략)…"


def trim_relevant(text: Column, limit: Column, units: Column, scores: Column, least: int = 300) -> Column:
    """A text cut to a limit: its best units by score as long as they fit, in their order, with a mark where some are left
    out; its beginning where the limit is below `least`, scores are missing or no unit fits."""
    by_score = F.array_sort(F.transform(units, lambda u, i: F.struct((-F.get(scores, i)).alias("s"), i.alias("i"), (F.length(u) + len(GAP) + 2).alias("cost"))))
    fits = lambda a, x: a["used"] + x["cost"] <= limit
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<int>").alias("kept"))
    kept = F.array_sort(F.aggregate(by_score, start, lambda a, x: F.struct(F.when(fits(a, x), a["used"] + x["cost"]).otherwise(a["used"]).alias("used"), F.when(fits(a, x), F.array_append(a["kept"], x["i"])).otherwise(a["kept"]).alias("kept")))["kept"])
    parts = F.transform(kept, lambda i, n: F.when((n > 0) & (F.get(kept, n - 1) != i - 1), F.concat(F.lit(f"{GAP}\n"), F.get(units, i))).otherwise(F.get(units, i)))
    plain = F.left(text, limit)
    return F.when(F.length(text) <= limit, text).when((limit < least) | scores.isNull() | (F.size(kept) == 0), plain).otherwise(F.array_join(parts, "\n"))


def build_context(hits: DataFrame, budget: int = 12_000, path: str = "section_path", body: str = "content", scores=None) -> DataFrame:
    """(query_id, context): each query's hits as numbered documents within a budget, shared as by allocate_context; a text
    beyond its share is trimmed by the scores of its units (a function of units to scores), or to its beginning."""
    head = F.concat(F.lit("[문서 "), F.col("rank").cast("string"), F.lit("]"), F.when(F.coalesce(path, F.lit("")) != "", F.concat(F.lit(" "), F.col(path))).otherwise(""))
    rows = hits.select("query_id", "rank", head.alias("head"), F.col(body).alias("body"), *[c for c in hits.columns if c not in ("query_id", "rank", "head", "body", "content")])
    shared = allocate_context(rows.withColumn("content", F.concat("head", F.lit("\n"), "body")), budget)
    limit = F.greatest(F.lit(0), F.col("n_chars") - F.length("head") - 1).cast("int")
    cut = shared.withColumn("limit", limit).withColumn("units", text_units(F.col("body")))
    cut = cut.withColumn("scores", scores(F.col("units")) if scores else F.lit(None).cast("array<double>"))
    block = F.concat("head", F.lit("\n"), trim_relevant(F.col("body"), F.col("limit"), F.col("units"), F.col("scores")))
    blocks = cut.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))).alias("b"))
    return blocks.select("query_id", F.array_join(F.transform("b", lambda x: x["block"]), "\n\n").alias("context"))


TABLES = "\n\n[인용된 표]\n"


def with_tables(text: Column, tables: Column, budget: int, least: int = 200) -> Column:
    """A text with as much of its tables as the budget leaves room for; none where that is less than `least`."""
    room = F.lit(budget) - F.length(text) - len(TABLES)
    shown = F.when(F.length(tables) > room, F.concat(F.rtrim(F.left(tables, F.greatest(room, F.lit(0)).cast("int"))), F.lit("\n(표 일부 생략 — 분량 제한)"))).otherwise(tables)
    return F.when((F.coalesce(tables, F.lit("")) == "") | (room < least), text).otherwise(F.concat(text, F.lit(TABLES), shown))


def siblings_text(children: DataFrame, keys: list[str]) -> DataFrame:
    """(parent_chunk_id, keys..., text): the texts of the children that share their numbers, in order, under the first
    line of the first, which all of them begin with."""
    rows = children.where("chunk_type = 'text'").select("parent_chunk_id", *[F.coalesce(k, F.lit("")).alias(k) for k in keys], "chunk_order", "content")
    parts = F.array_sort(F.collect_list(F.struct(F.coalesce("chunk_order", F.lit(0)).alias("o"), F.col("content").alias("c"))))
    grouped = rows.groupBy("parent_chunk_id", *keys).agg(parts.alias("p"))
    rest = F.transform("p", lambda x: F.when(F.contains(x["c"], F.lit("\n")), F.regexp_replace(x["c"], r"(?s)^[^\n]*\n", "")).otherwise(x["c"]))
    return grouped.select("parent_chunk_id", *keys, F.trim(F.concat_ws("\n", F.substring_index(F.get("p", F.lit(0))["c"], "\n", 1), F.array_join(rest, "\n"))).alias("text"))


def expand_graded(hits: DataFrame, parents: DataFrame, children: DataFrame, budget: int = 4000) -> DataFrame:
    """hits (chunk_id, parent_chunk_id, paragraph_no, item_no, content) with `expanded`, the largest of article, paragraph
    and item that a budget allows, else the hit's own text, and its `level`. An article beyond the budget only by its
    tables keeps its text and what fits of them. Siblings are gathered for articles beyond the budget alone."""
    text = F.coalesce("content", F.lit(""))
    held = parents.select(F.col("chunk_id").alias("parent_chunk_id"), text.alias("whole"), F.rtrim(F.substring_index(text, TABLES, 1)).alias("body"), F.when(F.contains(text, F.lit(TABLES)), F.regexp_replace(text, r"(?s)^.*?\n\n\[인용된 표\]\n", "")).otherwise("").alias("tables"))
    held = held.withColumn("fits", (F.col("whole") != "") & (F.length("whole") <= budget)).withColumn("body_fits", (F.col("body") != "") & (F.length("body") <= budget))
    large = children.join(held.where("NOT fits AND NOT body_fits").select("parent_chunk_id"), "parent_chunk_id", "left_semi")
    rows = hits.withColumn("p of graded", F.coalesce("paragraph_no", F.lit(""))).withColumn("i of graded", F.coalesce("item_no", F.lit("")))
    named = lambda keys, text: siblings_text(large, keys).select("parent_chunk_id", *[F.col(k).alias({"paragraph_no": "p of graded", "item_no": "i of graded"}[k]) for k in keys], F.col("text").alias(text))
    rows = rows.join(held, "parent_chunk_id", "left").join(named(["paragraph_no"], "paragraph"), ["parent_chunk_id", "p of graded"], "left").join(named(["paragraph_no", "item_no"], "item"), ["parent_chunk_id", "p of graded", "i of graded"], "left")
    ok = lambda c: (F.coalesce(c, F.lit("")) != "") & (F.length(c) <= budget)
    level = F.when(F.coalesce("fits", F.lit(False)) | F.coalesce("body_fits", F.lit(False)), "article").when(ok("paragraph"), "paragraph").when((F.col("p of graded") != "") & ok("item"), "item").otherwise("leaf")
    chosen = F.when(F.col("level") == "leaf", text).when(F.col("level") == "paragraph", with_tables(F.col("paragraph"), F.col("tables"), budget)).when(F.col("level") == "item", with_tables(F.col("item"), F.col("tables"), budget)).when(F.col("fits"), F.col("whole")).otherwise(with_tables(F.col("body"), F.col("tables"), budget))
    return rows.withColumn("level", level).withColumn("expanded", chosen).select(*hits.columns, "level", "expanded")


def expand_parents(hits: DataFrame, parents: DataFrame) -> DataFrame:
    """Hits with their parents' texts, one for each parent in the order of scores; a hit without a parent stays as it is."""
    held = parents.select(F.col("chunk_id").alias("parent of expand"), F.col("content").alias("text of expand"), F.lit(True).alias("held of expand"))
    joined = hits.join(held, hits["parent_chunk_id"] == held["parent of expand"], "left").withColumn("parent of expand", F.when(F.col("held of expand"), F.col("parent_chunk_id").cast("string")))
    kept = collapse_parents(joined, "parent of expand", "chunk_id", by=["query_id"])
    return kept.withColumn("content", F.coalesce("text of expand", "content")).drop("parent of expand", "text of expand", "held of expand")


def inject_context(messages: Column, context: Column, into: str = "system") -> Column:
    """Messages (array of struct role, content) with a context: in the system message, a new one if there is none, or in
    place of the last question. Without a context or a question they stay."""
    place = F.transform(messages, lambda m, i: F.when(m["role"] == into, i))
    asked = F.exists(messages, lambda m: (m["role"] == "user") & (F.coalesce(m["content"], F.lit("")) != ""))
    if into == "user":
        last = F.array_max(place)
        said = lambda m: F.concat(F.lit("[검색된 규정 조항]\n"), context, F.lit("\n\n[질문]\n"), m["content"])
        new = F.transform(messages, lambda m, i: F.struct(m["role"].alias("role"), F.when(i == last, said(m)).otherwise(m["content"]).alias("content")))
    else:
        first = F.array_min(place)
        own = F.transform(messages, lambda m, i: F.struct(m["role"].alias("role"), F.when(i == first, compose_system(m["content"], context)).otherwise(m["content"]).alias("content")))
        head = F.array(F.struct(F.lit("system").alias("role"), compose_system(F.lit(None).cast("string"), context).alias("content")))
        new = F.when(first.isNull(), F.concat(head, own)).otherwise(own)
    return F.when((F.coalesce(context, F.lit("")) == "") | ~asked, messages).otherwise(new)


def case_messages(question: Column, contexts: Column) -> Column:
    """The messages that ask a case's question, its contexts as the system's."""
    context = F.array_join(F.coalesce(contexts, F.array().cast("array<string>")), "\n\n")
    user = F.struct(F.lit("user").alias("role"), question.alias("content"))
    system = F.struct(F.lit("system").alias("role"), F.concat(F.lit("다음 컨텍스트를 근거로 답하라:\n"), context).alias("content"))
    return F.when(context == "", F.array(user)).otherwise(F.array(system, user))


def unverified_citations(answer: Column, context: Column, least: int = 15, most: int = 300, prefix: int = 60) -> Column:
    """Quotes in corner brackets whose beginning the context does not hold."""
    quotes = F.regexp_extract_all(answer, F.lit(f"「([^」]{{{least},{most}}})」"), F.lit(1))
    flat = lambda c: F.regexp_replace(c, SPACES, "")
    return F.filter(quotes, lambda q: ~F.contains(flat(context), F.substr(flat(q), F.lit(1), F.lit(prefix))))


def compose_system(base: Column, context: Column) -> Column:
    block = F.concat(F.lit("[Context]\n"), context)
    return F.when(F.coalesce(context, F.lit("")) == "", base).when(F.coalesce(base, F.lit("")) == "", block).otherwise(F.concat(base, F.lit("\n\n"), block))


def word_windows(text: Column, size: int = 512, overlap: int = 64) -> Column:
    """Windows of `size` words, each starting size - overlap after the one before."""
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")
    step = size - overlap
    n = F.greatest(F.ceil((F.size(words) - overlap) / step).cast("int"), F.lit(1))
    return F.when(F.size(words) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(words, i * step + 1, F.lit(size)), " ")))


@F.pandas_udf(ArrayType(IntegerType()))
def hashed_counts(texts: pd.Series) -> pd.Series:
    """256 buckets of tokens by MD5, each token counted up or down; only A to Z are lower-cased."""
    out = []
    for text in texts:
        counts = [0] * 256
        for token in re.findall("[0-9A-Za-z가-힣]+", text or ""):
            code = hashlib.md5(token.lower().encode("utf-8")).digest()
            counts[code[15]] += 1 if code[14] & 1 else -1
        out.append(np.array(counts, dtype=np.int32))
    return pd.Series(out)


hashed_counts = hashed_counts.asNondeterministic()  # a filter on counts would be moved below them, and texts hashed twice


def hashing_embedding(text: Column) -> Column:
    """The hashed counts at unit length; all zeros where there is no token, or where all cancel out."""
    once = lambda value, then: F.get(F.transform(F.array(value), then), F.lit(0))
    norm = lambda c: F.greatest(F.sqrt(F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x * x)), F.lit(1e-12))
    return once(hashed_counts(text), lambda c: once(norm(c), lambda n: F.transform(c, lambda x: x / n)))
