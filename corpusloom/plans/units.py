"""Units, spans and alignments of articles. The supplied documents have no numbered rules: lines get marks by their keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import alignment, probes, quotes, slot_merge
from corpusloom.operators import units as ops
from corpusloom.plans.registry import query, table

#: What the k-th kind of line begins with.
MARKS = ("2.1 ", "(1) ", "", "(a) ", "a) ", "Note: ", "3 ", "", "(i) ", "- ", "1) ", "", "(나) ", "b. ", "", "Notes. ", "4 ", "(2) ")


def marked_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, text): lines of documents, each with a mark that follows from its place and document."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    kind = (F.col("doc_id") * 7 + F.col("pos") * F.col("pos") * 5 + F.col("pos")) % len(MARKS)
    return lines.select("doc_id", "pos", F.concat(F.get(F.array(*[F.lit(m) for m in MARKS]), kind.cast("int")), "line").alias("text"))


#: The same in SQL.
MARKED = f"""l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS line FROM documents),
m AS (SELECT doc_id, pos, ([{", ".join(f"'{m}'" for m in MARKS)}])[1 + (doc_id * 7 + pos * pos * 5 + pos) % {len(MARKS)}] || line AS t FROM l)"""
STYLE = "CASE " + " ".join(f"WHEN regexp_matches(t, '{pattern}') THEN '{name}'" for name, pattern in ops.STYLES) + " END"


@query(rf"""WITH {MARKED}, a AS (SELECT *, regexp_matches(t, '{ops.NOTE}') AS note FROM m),
b AS (SELECT *, NOT note AND regexp_matches(t, '{ops.DECIMAL}') AS hard, NOT note AND NOT regexp_matches(t, '{ops.DECIMAL}') AND regexp_matches(t, '{ops.BARE}') AS bare, regexp_extract(t, '^(\S*)', 1) AS token FROM a),
c AS (SELECT *, coalesce(last_value(CASE WHEN note OR hard THEN note END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS in_note, coalesce(lag(note) OVER (PARTITION BY doc_id ORDER BY pos), true) AS after_note FROM b),
d AS (SELECT *, hard OR (bare AND NOT in_note) AS para, bare AND in_note AS foot FROM c),
e AS (SELECT *, CASE WHEN NOT (note OR para OR foot) THEN {STYLE} END AS style, sum(CASE WHEN note OR para THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS scope FROM d),
f AS (SELECT *, coalesce(style = first_value(style IGNORE NULLS) OVER (PARTITION BY doc_id, scope ORDER BY pos ROWS UNBOUNDED PRECEDING), false) AS item, first_value(note) OVER (PARTITION BY doc_id, scope ORDER BY pos) AS scope_note,
   first_value(CASE WHEN para THEN token END) OVER (PARTITION BY doc_id, scope ORDER BY pos) AS scope_para, first_value(CASE WHEN para THEN substr(trim(regexp_replace(t, '^\S+\s*', '')), 1, {ops.TITLE_CHARS}) END) OVER (PARTITION BY doc_id, scope ORDER BY pos) AS scope_title FROM e),
g AS (SELECT *, style IS NOT NULL AND NOT item AS below, sum(CASE WHEN item THEN 1 ELSE 0 END) OVER w AS items, sum(CASE WHEN item OR foot THEN 1 ELSE 0 END) OVER w AS resets, last_value(CASE WHEN item OR foot THEN token END IGNORE NULLS) OVER (PARTITION BY doc_id, scope ORDER BY pos ROWS UNBOUNDED PRECEDING) AS cur_item FROM f WINDOW w AS (PARTITION BY doc_id, scope ORDER BY pos)),
h AS (SELECT *, coalesce(below AND style = first_value(CASE WHEN below THEN style END IGNORE NULLS) OVER (PARTITION BY doc_id, scope, items ORDER BY pos ROWS UNBOUNDED PRECEDING), false) AS sub FROM g),
i AS (SELECT *, last_value(CASE WHEN sub THEN token END IGNORE NULLS) OVER (PARTITION BY doc_id, scope, resets ORDER BY pos ROWS UNBOUNDED PRECEDING) AS cur_sub, para OR foot OR style IS NOT NULL OR (after_note AND NOT note) AS starts FROM h),
j AS (SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) + CASE WHEN note THEN 1 ELSE 0 END AS unit, CASE WHEN scope_note THEN 'Note' ELSE coalesce(rtrim(scope_para, '.'), '') END AS para_no, CASE WHEN scope_note THEN 'Note' ELSE coalesce(scope_title, '') END AS para_title, foot OR style IS NOT NULL AS marked FROM i),
s AS (SELECT doc_id, unit, CASE WHEN para THEN para_no WHEN marked THEN token ELSE '' END AS heading, para_no, para_title, CASE WHEN marked THEN coalesce(cur_item, '') ELSE '' END AS item_no, CASE WHEN sub THEN token WHEN below THEN concat_ws('.', cur_sub, token) ELSE '' END AS sub_item_no, pos AS first_piece FROM j WHERE starts),
u AS (SELECT doc_id, unit, md5(string_agg(t, chr(10) ORDER BY pos)) AS text_md5, count(*) AS n_pieces, max(pos) + 1 AS past FROM j GROUP BY doc_id, unit)
SELECT u.doc_id, CAST(u.unit AS BIGINT) AS unit, coalesce(heading, '') AS heading, coalesce(para_no, 'Note') AS para_no, coalesce(para_title, 'Note') AS para_title, coalesce(item_no, '') AS item_no, coalesce(sub_item_no, '') AS sub_item_no, CAST(coalesce(first_piece, past) AS INTEGER) AS first_piece, n_pieces, text_md5 FROM u LEFT JOIN s USING (doc_id, unit)""")
def enumerated_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' lines as pieces of articles, resolved to paragraphs, items, sub-items and footnotes."""
    units = ops.resolve_units(marked_lines(table(spark, sf_dir, "documents")), ["doc_id"])
    return units.select("doc_id", "unit", "heading", "para_no", "para_title", "item_no", "sub_item_no", "first_piece", "n_pieces", F.md5("text").alias("text_md5"))


FLAT_AT = "list_filter(list_transform(string_split(text, ''), lambda c, i: CASE WHEN regexp_matches(c, '^[\\s\\pZ]$') THEN NULL ELSE i END), lambda x: x IS NOT NULL)"


@query(rf"""WITH d AS (SELECT doc_id, text, substr(text, CAST(1 + doc_id % 40 AS BIGINT), 60) AS said FROM documents),
q AS (SELECT *, CASE doc_id % 4 WHEN 0 THEN said WHEN 1 THEN replace(said, ' ', chr(10) || '  ') WHEN 2 THEN replace(said, ' ', '') ELSE 'not in the text at all: ' || doc_id END AS quote FROM d),
f AS (SELECT *, regexp_replace(quote, '[\s\pZ]+', '', 'g') AS flat, instr(text, quote) AS plain FROM q WHERE doc_id % 4 <> 3 AND trim(said) <> ''),
g AS (SELECT *, {FLAT_AT} AS places FROM f), h AS (SELECT *, instr(array_to_string(list_transform(places, lambda i: substr(text, i, 1)), ''), flat) AS k FROM g WHERE plain = 0),
s AS (SELECT doc_id, plain - 1 AS a, plain - 1 + length(quote) AS b FROM f WHERE plain > 0 UNION ALL SELECT doc_id, places[k] - 1, places[k + length(flat) - 1] FROM h WHERE k > 0)
SELECT q.doc_id, CAST(coalesce(s.a, -1) AS INTEGER) AS char_start, CAST(coalesce(s.b, -1) AS INTEGER) AS char_end, CASE WHEN regexp_replace(quote, '[\s\pZ]+', '', 'g') = '' THEN '' ELSE left(sha1(regexp_replace(quote, '[\s\pZ]+', '', 'g')), 12) END AS quote_hash FROM q LEFT JOIN s USING (doc_id)""")
def quote_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stretch of each document as a quote: as it is, with other white space, without any, or not from there."""
    said, k = F.substr("text", (F.col("doc_id") % 40 + 1).cast("int"), F.lit(60)), F.col("doc_id") % 4
    quote = F.when(k == 0, said).when(k == 1, F.replace(said, F.lit(" "), F.lit("\n  "))).when(k == 2, F.replace(said, F.lit(" "), F.lit(""))).otherwise(F.concat(F.lit("not in the text at all: "), F.col("doc_id")))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("article_text"), quote.alias("quote"))
    return quotes.evidence_meta(rows, chunk=None).select("doc_id", "char_start", "char_end", "quote_hash")


@query()
def snapped_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stretch of each document with two letters changed, brought back to the document's wording."""
    start = F.when(F.length("text") > 90, (F.col("doc_id") % 20 + 1).cast("int")).otherwise(1)
    said = F.substr("text", start, F.lit(70))
    changed = F.concat(F.left(said, F.lit(21)), F.lit("Q"), F.substr(said, F.lit(23), F.lit(24)), F.lit("ZZ"), F.substr(said, F.lit(48), F.lit(30)))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("article_text"), changed.alias("quote"))
    return quotes.evidence_meta(rows, chunk=None).select("doc_id", "quote", "quote_raw", "quote_snapped", "char_start", "char_end")


COMPARABLE = r"lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '(?s)\$\$.*?\$\$|\$[^$\n]*\$', '', 'g'), '!\[.*?\]\([^)]*\)', '', 'g'), '[#*_>`|●•▪◦·–—]', ' ', 'g'), '[\s\pZ]+', ' ', 'g')))"


@query(rf"""WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(replace(text, '$', ''), chr(10))) AS line FROM documents),
b AS (SELECT *, count(*) FILTER (trim(line) <> '') OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS block, {COMPARABLE.format('line')} <> '' AS told, pos // 3 AS unit FROM l)
SELECT doc_id, CAST(unit AS VARCHAR) AS unit_id, CAST(min(block) FILTER (told) AS INTEGER) AS first_block, CAST(max(block) FILTER (told) AS INTEGER) AS last_block FROM b GROUP BY doc_id, unit""")
def unit_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's lines as blocks of a source, and three lines each as units; without $, as a formula could begin in one line and end in another."""
    docs = table(spark, sf_dir, "documents").withColumn("text", F.replace("text", F.lit("$"), F.lit("")))
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    units = lines.groupBy("doc_id", F.floor(F.col("pos") / 3).alias("unit_id")).agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("x")).select("doc_id", "unit_id", F.col("unit_id").alias("ord"), F.array_join(F.transform("x", lambda r: r["line"]), "\n").alias("text"))
    source = docs.select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return alignment.align_units(units, source).select("doc_id", "unit_id", "first_block", "last_block")


@query()
def merged_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as slots of a page that lost some letters, their sentences as the text layer's segments."""
    turns = table(spark, sf_dir, "conversations").where("text <> ''")
    box = lambda top, height: F.array(F.lit(50.0), top.cast("double"), F.lit(550.0), (top + height).cast("double"))
    slots = turns.select("conv_id", F.col("turn").cast("string").alias("slot_id"), F.col("turn").alias("ord"), F.regexp_replace("text", "[aeu](?=[nr])", "").alias("text"), F.when(F.col("conv_id") % 3 != 0, box(F.col("turn") * 100, 90)).alias("bbox"))
    parts = turns.select("conv_id", "turn", F.posexplode(F.split("text", r"(?<=[.!?])\s+")).alias("k", "text"))
    segments = parts.select("conv_id", (F.col("turn") * 10_000 + F.col("k")).alias("ord"), "text", F.when(F.col("conv_id") % 3 != 0, box(F.col("turn") * 100 + F.col("k") * 10, 9)).alias("bbox"))
    return slot_merge.merge_slots(slots, segments, ["conv_id"])


OUTLINE = ("1. ", "(1) ", "(가) ", "", "(2) ", "(나) ", "2. ", "", "(3) ", " (다)")


@query(rf"""WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS line FROM documents),
m AS (SELECT doc_id, pos, ([{", ".join(f"'{m}'" for m in OUTLINE)}])[1 + (doc_id * 3 + pos * 7 + pos * pos) % {len(OUTLINE)}] || line AS t FROM l),
x AS (SELECT *, nullif(regexp_extract(t, '{probes.LEVELS[0]}', 1), '') AS l1, nullif(regexp_extract(t, '{probes.LEVELS[1]}', 1), '') AS x2, nullif(regexp_extract(t, '{probes.LEVELS[2]}', 1), '') AS x3 FROM m),
y AS (SELECT *, CASE WHEN l1 IS NULL THEN x2 END AS l2, CASE WHEN l1 IS NULL AND x2 IS NULL THEN x3 END AS l3, count(l1) OVER (PARTITION BY doc_id ORDER BY pos) AS scope FROM x),
z AS (SELECT *, last_value(l1 IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS first, last_value(l2 IGNORE NULLS) OVER (PARTITION BY doc_id, scope ORDER BY pos ROWS UNBOUNDED PRECEDING) AS second FROM y)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, first, second, l3 AS third, left(trim(t), 300) AS line FROM z WHERE l3 IS NOT NULL AND first IS NOT NULL AND second IS NOT NULL""")
def outline_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' lines as an outline, their marks by their place and document: the leaves with their path."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    kind = (F.col("doc_id") * 3 + F.col("pos") * 7 + F.col("pos") * F.col("pos")) % len(OUTLINE)
    marked = lines.select("doc_id", "pos", F.concat(F.get(F.array(*[F.lit(m) for m in OUTLINE]), kind.cast("int")), "line").alias("line"))
    texts = marked.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("x")).select("doc_id", F.array_join(F.transform("x", lambda r: r["line"]), "\n").alias("content"))
    return probes.outline_leaves(texts, "doc_id")
