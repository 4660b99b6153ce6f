"""Structure queries over pages and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import table_functions
from corpusloom.functions.html import row_text, table_grid
from corpusloom.functions.text import number_set, strip_markup, unsupported_numbers
from corpusloom.operators import structure as ops
from corpusloom.plans.registry import ORACLES, query, table

BARE = r"regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
DECODED = f"""replace(replace(replace(replace(replace(replace({BARE}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&')"""


@query(rf"SELECT page_id, trim(regexp_replace({DECODED}, '[\s\pZ]+', ' ', 'g')) AS text FROM pages")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", strip_markup(F.col("html")).alias("text"))


@query("""WITH n AS (SELECT n_regionkey, n_nationkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k, count(*) OVER (PARTITION BY n_regionkey) AS rows FROM nation),
r AS (SELECT n_regionkey AS page_id, k AS pos, 'Region: ' || r_name || ' | Key: ' || n_nationkey || CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE ' | Name: ' || n_name END AS text FROM n JOIN region ON n_regionkey = r_regionkey)
SELECT page_id, pos, text FROM r UNION ALL SELECT n_regionkey, max(rows) + 1, 'Total' FROM n GROUP BY n_regionkey""")
def page_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of tables as 'header: value' text, from pages made of the nations."""
    grids = region_pages(spark, sf_dir).select("page_id", table_grid(F.col("html")).alias("grid"))
    rows = grids.select("page_id", F.get("grid", F.lit(0)).alias("header"), F.posexplode("grid").alias("pos", "row")).where("pos > 0")
    return rows.select("page_id", "pos", row_text(F.col("header"), F.col("row")).alias("text"))


REGION_ROWS = ORACLES["page_tables"]


@query(REGION_ROWS)
def lateral_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in SQL, by a table function of each page."""
    table_functions.register(spark)
    return spark.sql("SELECT page_id, r.pos, r.text FROM {pages}, LATERAL table_rows(html) r", pages=region_pages(spark, sf_dir))


@query(r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(trim(text), '[\s\x1c-\x1f\x{85}\pZ]+'), lambda w: w <> '') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(CASE WHEN len(w) = 0 THEN 0 ELSE greatest(CAST(ceil((len(w) - 64) / 448.0) AS BIGINT), 1) END)) AS pos FROM w)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, CAST(pos * 448 AS INTEGER) AS word_start, md5(array_to_string(w[pos * 448 + 1 : pos * 448 + 512], ' ')) AS text_md5 FROM p""")
def lateral_word_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's windows of 512 words that overlap by 64, by a table function in SQL."""
    table_functions.register(spark)
    return spark.sql("SELECT doc_id, w.pos, w.word_start, md5(w.text) AS text_md5 FROM {documents}, LATERAL word_windows(text, 512, 64) w", documents=table(spark, sf_dir, "documents").select("doc_id", "text"))


def region_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each region with the table of its nations: the region's name spans its rows, some names are blank, and
    the last row is one cell over all columns. No supplied page has a table."""
    region = table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    nations = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("ns"))
    first = lambda i: F.when(i == 0, F.concat(F.lit("<td rowspan="), F.size("ns").cast("string"), F.lit(">"), F.col("r_name"), F.lit("</td>"))).otherwise("")
    name = lambda x: F.when(x["n_nationkey"] % 3 == 0, " ").otherwise(x["n_name"])
    body = F.array_join(F.transform("ns", lambda x, i: F.concat(F.lit("<tr>"), first(i), F.lit("<td>"), x["n_nationkey"].cast("string"), F.lit("</td><td>"), name(x))), "")
    html = F.concat(F.lit("<table><tr><th>Region<th>Key<th>Name</tr>"), body, F.lit("<tr><td colspan=3>Total</td></tr></table>"))
    return nations.join(region, "n_regionkey").select(F.col("n_regionkey").alias("page_id"), html.alias("html"))


@query()
def supplied_page_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over the supplied pages."""
    grids = table(spark, sf_dir, "pages").where("html LIKE '%<t%'").select("page_id", table_grid(F.col("html")).alias("grid"))
    rows = grids.select("page_id", F.get("grid", F.lit(0)).alias("header"), F.posexplode("grid").alias("pos", "row")).where("pos > 0")
    return rows.select("page_id", "pos", row_text(F.col("header"), F.col("row")).alias("text"))


@query()
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.link_siblings(ops.chunk_documents(table(spark, sf_dir, "documents")))


@query()
def chunk_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.chunk_audit(ops.chunk_documents(table(spark, sf_dir, "documents")))


@query(r"""WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS line FROM documents), s AS (SELECT *, length(line) < 80 AS short FROM l),
g AS (SELECT *, sum(CASE WHEN short IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM (SELECT *, lag(short) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM s))
SELECT doc_id, CAST(island AS BIGINT) AS island, short, count(*) AS n_parts, CAST(sum(length(line)) + count(*) - 1 AS BIGINT) AS n_chars FROM g GROUP BY doc_id, island, short""")
def line_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of short and of long lines, merged."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).withColumn("short", F.length("line") < 80)
    merged = ops.merge_adjacent(lines, ["doc_id"], "i", ["short"], "line")
    return merged.select("doc_id", "island", "short", "n_parts", F.length("line").cast("long").alias("n_chars"))


@query(r"""WITH n AS (SELECT doc_id, list_sort(list_distinct(list_transform(regexp_extract_all(text, '\d+(?:,\d{3})*(?:\.\d+)?'), lambda x: replace(x, ',', '')))) AS numbers FROM documents) SELECT doc_id, array_to_string(numbers, ' ') AS numbers FROM n WHERE len(numbers) > 0""")
def number_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", number_set(F.col("text")).alias("n")).where(F.size("n") > 0).select("doc_id", F.array_join("n", " ").alias("numbers"))


@query(r"""WITH s AS (SELECT conv_id, turn, text || ' ' || (conv_id % 9 + turn % 3) || ' and 1,0' || (turn % 2) || '0' AS text FROM conversations), t AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS evidence FROM s), n AS (SELECT conv_id, turn, list_distinct(list_transform(regexp_extract_all(text, '\d+(?:,\d{3})*(?:\.\d+)?'), lambda x: replace(x, ',', ''))) AS a,
list_transform(regexp_extract_all(evidence, '\d+(?:,\d{3})*(?:\.\d+)?'), lambda x: replace(x, ',', '')) AS e FROM t WHERE evidence IS NOT NULL)
SELECT conv_id, turn, CAST(len(list_filter(a, lambda x: NOT list_contains(e, x))) AS BIGINT) AS n_unsupported FROM n WHERE len(a) > 0""")
def unsupported_numbers_in_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of a turn that the turn before does not hold; some are put in by key, as the supplied turns hold none."""
    from pyspark.sql import Window

    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    said = F.concat(F.col("text"), F.lit(" "), (F.col("conv_id") % 9 + F.col("turn") % 3).cast("string"), F.lit(" and 1,0"), (F.col("turn") % 2).cast("string"), F.lit("0"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", said.alias("text")).withColumn("evidence", before).where("evidence IS NOT NULL").where(F.size(number_set(F.col("text"))) > 0)
    return rows.select("conv_id", "turn", F.size(unsupported_numbers(F.col("text"), F.col("evidence"))).cast("long").alias("n_unsupported"))
