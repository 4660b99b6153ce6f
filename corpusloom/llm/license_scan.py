"""License scan by diagonal voting, in DataFrame operations alone.

Rolling hashes of word pairs of every document are joined with their positions in the templates (a table of a
fixed size, so it is broadcast). Each hit votes for the diagonal document position - template position. Votes
are checked word by word, counted by diagonal, neighbouring diagonals of a template are merged (words put in or
left out), and a merged span counts if enough of the template's pairs stand in it. A sentinel hash at the end
of each document's list matches one template row, so every document keeps a row, with its number of words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Phrases that count at each place where their words stand consecutively, with their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
# Notices found also with words changed, put in or left out, with their labels.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("released under the mit license", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("you may obtain a copy of the license at http www apache org licenses license 2 0", "apache"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("all rights reserved", "all-rights-reserved"),
)
# A pair of these words alone gives no vote in a notice.
COMMON = ("a", "and", "are", "at", "in", "is", "it", "of", "or", "the", "this", "to", "with", "you")

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SENTINEL = -1


def template_rows(base=BASE, notices=NOTICES) -> list[tuple[int, int, str, str, str, bool, int]]:
    """(template, position, word, next word, label, is base, votes that a full match has)."""
    rows = []
    for t, (phrase, label) in enumerate([*base, *notices]):
        words, is_base = phrase.split(), t < len(base)
        pairs = [(i, a, b) for i, (a, b) in enumerate(zip(words, words[1:], strict=False)) if is_base or not (a in COMMON and b in COMMON)]
        rows += [(t, i, a, b, label, is_base, len(pairs)) for i, a, b in pairs]
    return rows


def _templates(spark: SparkSession, base, notices) -> DataFrame:
    values = ", ".join(f"({t}, {i}, '{a}', '{b}', '{label}', {str(is_base).lower()}, {full})" for t, i, a, b, label, is_base, full in template_rows(base, notices))
    rows = spark.sql(f"SELECT * FROM VALUES {values} AS t(tid, tpos, w0, w1, label, is_base, full_votes)")
    rows = rows.withColumn("h", F.xxhash64("w0", "w1"))
    end = spark.sql(f"SELECT {SENTINEL} AS tid, 0 AS tpos, '' AS w0, '' AS w1, '' AS label, false AS is_base, 1 AS full_votes, {SENTINEL}L AS h")
    return rows.unionByName(end)


def scan_licenses(docs: DataFrame, *, base=BASE, notices=NOTICES, slack: int = 2, least: float = 0.75) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: one row for each row of docs.

    A null or empty text has no words: zero counts, null positions, empty labels, score 0. Repeated rows and
    null ids give a row each. Only doc_id and text are read, so other columns may have any name. Very long
    texts give more rows to the shuffle, never a larger group than their own hits. An empty table gives no rows.
    slack: how far apart neighbouring diagonals may be; least: the share of a notice's pairs that must be there.
    score is the largest share reached by a counted label, 0 without labels.
    """
    spark = docs.sparkSession
    text = F.lower(F.replace(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit("K"), F.lit("Ķ")))  # only the Kelvin sign has an ASCII lower case
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)).alias("words"))
    words = F.col("words")
    hashed = rows.withColumn("hashes", F.array_append(F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1))), F.lit(SENTINEL).cast("long")))
    grams = hashed.select("rid", "doc_id", "words", F.posexplode("hashes").alias("pos", "h"))
    hits = grams.join(F.broadcast(_templates(spark, base, notices)), "h").where((F.col("tid") == SENTINEL) | ((F.get(words, F.col("pos")) == F.col("w0")) & (F.get(words, F.col("pos") + 1) == F.col("w1"))))
    dealt = hits.select("rid", "doc_id", "tid", "label", "is_base", "full_votes", "tpos", "pos", (F.col("pos") - F.col("tpos")).alias("diag")).repartition("rid")
    diagonals = dealt.groupBy("rid", "doc_id", "tid", "label", "is_base", "full_votes", "diag").agg(F.count("*").alias("votes"), F.collect_set("tpos").alias("at"), F.max("pos").alias("last_pos"))
    diagonals = diagonals.withColumn("exact", F.col("is_base") & (F.col("votes") == F.col("full_votes")))
    along = Window.partitionBy("rid", "doc_id", "tid").orderBy("diag")
    starts = F.when(F.col("diag") - F.lag("diag").over(along) <= slack, 0).otherwise(1)
    merged = diagonals.withColumn("starts", starts).withColumn("cluster", F.sum("starts").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    spans = merged.groupBy("rid", "doc_id", "tid", "label", "is_base", "full_votes", "cluster").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("covered"), F.sum(F.col("exact").cast("long")).alias("n_exact"),
        F.min(F.when(F.col("exact"), F.col("diag"))).alias("first"), F.max(F.when(F.col("exact"), F.col("diag"))).alias("last"), F.max("last_pos").alias("last_pos"))
    share = F.col("covered") / F.col("full_votes")
    real = F.col("tid") != SENTINEL
    counted = F.when(F.col("is_base"), F.col("n_exact") > 0).otherwise(share >= least) & real
    joined = lambda cond: F.array_join(F.array_sort(F.collect_set(F.when(cond, F.col("label")))), ",")
    return spans.groupBy("rid", "doc_id").agg(
        F.max(F.when(~real, F.col("last_pos"))).cast("long").alias("n_words"), F.sum(F.when(real, F.col("n_exact")).otherwise(0)).cast("long").alias("n_base"),
        F.min("first").cast("long").alias("first_word"), F.max("last").cast("long").alias("last_word"),
        joined(F.col("is_base") & counted).alias("base_labels"), joined(counted).alias("labels"), F.coalesce(F.max(F.when(counted, share)), F.lit(0.0)).alias("score"),
    ).drop("rid")


def oracle() -> str:
    """The same in DuckDB's SQL, by plain joins on the words themselves."""
    values = ", ".join(f"({t}, {i}, '{a}', '{b}', '{label}', {is_base}, {full})" for t, i, a, b, label, is_base, full in template_rows())
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
WITH t(tid, tpos, w0, w1, label, is_base, full_votes) AS (VALUES {values}),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '{WORD}') AS words FROM documents),
w AS (SELECT rid, unnest(words) AS w, generate_subscripts(words, 1) - 1 AS pos FROM d),
p AS (SELECT a.rid, a.pos, a.w AS w0, b.w AS w1 FROM w a JOIN w b ON a.rid = b.rid AND b.pos = a.pos + 1),
h AS (SELECT p.rid, t.tid, t.label, t.is_base, t.full_votes, t.tpos, p.pos, p.pos - t.tpos AS diag FROM p JOIN t ON p.w0 = t.w0 AND p.w1 = t.w1),
g AS (SELECT rid, tid, label, is_base, full_votes, diag, count(*) AS votes, list(tpos) AS ats FROM h GROUP BY ALL),
m AS (SELECT *, is_base AND votes = full_votes AS exact, CASE WHEN diag - lag(diag) OVER (PARTITION BY rid, tid ORDER BY diag) <= 2 THEN 0 ELSE 1 END AS starts FROM g),
c AS (SELECT *, sum(starts) OVER (PARTITION BY rid, tid ORDER BY diag ROWS UNBOUNDED PRECEDING) AS cluster FROM m),
s AS (SELECT rid, tid, label, is_base, full_votes, cluster, len(list_distinct(flatten(list(ats)))) / full_votes AS share, count(*) FILTER (exact) AS n_exact, min(diag) FILTER (exact) AS first, max(diag) FILTER (exact) AS last FROM c GROUP BY rid, tid, label, is_base, full_votes, cluster),
k AS (SELECT *, CASE WHEN is_base THEN n_exact > 0 ELSE share >= 0.75 END AS counted FROM s),
r AS (SELECT rid, sum(n_exact) AS n_base, min(first) AS first_word, max(last) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (is_base AND counted) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (counted) AS labels, max(share) FILTER (counted) AS score FROM k GROUP BY rid)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(coalesce(r.n_base, 0) AS BIGINT) AS n_base, CAST(r.first_word AS BIGINT) AS first_word, CAST(r.last_word AS BIGINT) AS last_word,
       coalesce(r.base_labels, '') AS base_labels, coalesce(r.labels, '') AS labels, CAST(coalesce(r.score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN r USING (rid)"""
