"""Reference queries over articles made of the parts: each names another article by numbers known from its key, so the
SQL says by arithmetic what the operators read from the texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import probes
from corpusloom.operators import references as ops
from corpusloom.plans.registry import query, table

A = """a AS (SELECT p_partkey AS k, 'P' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS chunk_id, p_partkey % 8 + 1 AS part, p_partkey % 5 + 1 AS ch, 101 + p_partkey % 149 AS art, CASE WHEN p_partkey % 11 = 0 THEN 'guidance' ELSE 'rule' END AS kind,
(p_partkey * 3) % 8 + 1 AS rpart, (p_partkey * 7) % 5 + 1 AS rch, 101 + (p_partkey * 13) % 149 AS rart, p_partkey % 6 AS form, p_partkey % 3 <> 0 AS has_item FROM part)"""


def picked(join: str) -> str:
    """The only other article that a join finds, with the paragraph that the reference names."""
    return f"j AS (SELECT a.chunk_id, a.form, min(t.chunk_id) AS target, count(*) AS n, bool_and(t.has_item) AS item FROM a JOIN a t ON {join} AND t.chunk_id <> a.chunk_id GROUP BY a.chunk_id, a.form)"


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    num = lambda c: c.cast("string")
    ref = F.concat(num((k * 7) % 5 + 1), F.lit("장 "), num(F.lit(101) + (k * 13) % 149), F.lit(".의 1항에 따른다."))
    bare = F.concat(F.lit("강도 요건은 "), num(F.lit(101) + (k * 13) % 149), F.lit(".의 1항에 따른다."))
    said = (
        F.when(k % 6 == 0, ref).when(k % 6 == 1, F.concat(F.lit("지침 "), ref)).when(k % 6 == 2, F.concat(num((k * 3) % 8 + 1), F.lit("편 "), ref)).when(k % 6 == 3, F.concat(F.lit("시험선박규칙 "), ref)).when(k % 6 == 4, bare)
        .otherwise(F.concat(F.lit("이 조에도 불구하고 "), num(F.lit(101) + (k * 13) % 149), F.lit(".을 우선 적용한다.")))
    )
    body = F.when(k % 3 != 0, F.lit("1. 강도 요건은 다음과 같다.")).otherwise("2. 강도 요건이 없다.")
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("P"), F.lpad(num(k), 9, "0")).alias("chunk_id"), F.concat(num(k % 8 + 1), F.lit("편_시험선박규칙_"), num(k % 8 + 1)).alias("source_file"), F.when(k % 11 == 0, "guidance").otherwise("rule").alias("document_type"),
        num(k % 5 + 1).alias("chapter_no"), F.lit("1").alias("section_no"), num(F.lit(101) + k % 149).alias("article_no"), F.when(k % 17 == 0, F.concat(F.lit("용어의 정의 "), num(k))).otherwise(F.col("p_name")).alias("article_title"), F.concat(F.lit("본문 "), said, F.lit("\n"), body).alias("content"), k.alias("k"), "p_name",
    )


@query(f"""WITH {A}, {picked("a.form IN (0, 1) AND t.part = a.part AND t.ch = a.rch AND t.art = a.rart AND t.kind = CASE a.form WHEN 1 THEN 'guidance' ELSE 'rule' END AND NOT (a.form = 0 AND a.rch = a.ch AND a.rart = a.art)")}
SELECT chunk_id, target, CASE form WHEN 1 THEN 'guidance' ELSE 'rule' END AS target_type FROM j WHERE n = 1 AND item""")
def chapter_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.chapter_references(articles(spark, sf_dir)).select("chunk_id", "target", "target_type")


@query(f"""WITH {A}, n AS (SELECT a.chunk_id, a.form, min(t.chunk_id) FILTER (t.ch = a.ch) AS near, count(*) FILTER (t.ch = a.ch) AS n_near, min(t.chunk_id) AS wide, count(*) AS n FROM a JOIN a t ON t.part = a.part AND t.art = a.rart AND t.kind = 'rule' AND t.chunk_id <> a.chunk_id WHERE a.form IN (4, 5) AND a.rart <> a.art GROUP BY a.chunk_id, a.form),
c AS (SELECT chunk_id, form, CASE WHEN n_near = 1 THEN near WHEN n_near = 0 AND n = 1 THEN wide END AS target FROM n) SELECT c.chunk_id, c.target FROM c JOIN a t ON t.chunk_id = c.target WHERE t.has_item OR c.form = 5""")
def bare_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.bare_references(articles(spark, sf_dir)).select("chunk_id", "target")


@query(f"""WITH {A}, {picked("a.form = 2 AND t.part = a.rpart AND t.ch = a.rch AND t.art = a.rart AND t.kind = 'rule'")} SELECT chunk_id, target, '1 number' AS form FROM j WHERE n = 1 AND item""")
def cross_document_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.cross_document_references(articles(spark, sf_dir))


@query(f"""WITH {A}, s AS (SELECT a.*, k % 10 = 0 AS asks, k % 41 AS term FROM a), c AS (SELECT q.chunk_id, count(*) FILTER (t.k % 3 = 0) AS titled, min(t.chunk_id) FILTER (t.k % 3 = 0) AS by_title, count(*) FILTER (t.asks) AS texts, min(t.chunk_id) FILTER (t.asks) AS by_text
FROM s q JOIN s t ON t.part = q.rpart AND t.ch = q.rch AND t.term = q.term AND t.kind = 'rule' WHERE q.asks AND NOT (q.rpart = q.part AND q.rch = q.ch) GROUP BY q.chunk_id),
x AS (SELECT chunk_id, CASE WHEN titled = 1 THEN by_title WHEN titled = 0 AND texts = 1 THEN by_text END AS target FROM c) SELECT chunk_id, target, '2 term' AS form FROM x WHERE target <> chunk_id""")
def cross_document_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References by a term that one title of the named chapter holds, or else one text."""
    rows, num = articles(spark, sf_dir), lambda c: c.cast("string")
    term = F.concat(F.lit("압력용기"), F.lpad(num(F.col("k") % 41), 2, "0"))
    asks = F.concat(num((F.col("k") * 3) % 8 + 1), F.lit("편 "), num((F.col("k") * 7) % 5 + 1), F.lit("장에서 규정하는 "), term, F.lit("에 따른다"))
    made = rows.withColumn("content", F.when(F.col("k") % 10 == 0, asks).otherwise("본문")).withColumn("article_title", F.when(F.col("k") % 3 == 0, term).otherwise("제목"))
    return ops.cross_document_references(made)


@query(f"""WITH {A}, m AS (SELECT a.*, CASE WHEN k % 9 = 0 THEN 'guidance' ELSE 'rule' END AS want FROM a WHERE k % 2 = 0), j AS (SELECT m.chunk_id, min(t.chunk_id) AS target, count(*) AS n, bool_and(t.has_item) AS item FROM m JOIN a t ON t.part = m.rpart AND t.ch = m.rch AND t.art = m.rart AND t.kind = m.want AND t.chunk_id <> m.chunk_id GROUP BY m.chunk_id)
SELECT chunk_id, target, '3 structured' AS form FROM j WHERE n = 1 AND item""")
def structured_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, num = articles(spark, sf_dir), lambda c: c.cast("string")
    k = F.col("k")
    target = F.concat(F.when(k % 9 == 0, "지침 ").otherwise(""), num((k * 3) % 8 + 1), F.lit("편 "), num((k * 7) % 5 + 1), F.lit("장 "), num(F.lit(101) + (k * 13) % 149), F.lit(".의 1항"))
    listed = F.when(k % 2 == 0, F.array(F.struct(F.lit("table").alias("ref_type"), F.lit("표 1.1").alias("target")), F.struct(F.lit("internal_article").alias("ref_type"), target.alias("target"))))
    return ops.cross_document_references(rows.withColumn("references", listed).withColumn("content", F.regexp_replace("content", r"\d+(편|장)", "")))


@query(f"""WITH {A}, d AS (SELECT a.*, k % 8 + 1 AS doc FROM a), j AS (SELECT a.chunk_id, min(t.chunk_id) AS target, count(*) AS n, bool_and(t.has_item) AS item FROM d a JOIN d t ON a.form = 3 AND t.doc = (a.k * 5) % 8 + 1 AND t.ch = a.rch AND t.art = a.rart AND t.kind = 'rule' AND t.chunk_id <> a.chunk_id GROUP BY a.chunk_id) SELECT chunk_id, target FROM j WHERE n = 1 AND item""")
def named_document_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References by a part of a document's name that no other document's name holds."""
    k, num = F.col("k"), lambda c: c.cast("string")
    names = F.array(*[F.lit(f"{c}화물선박규칙") for c in "가나다라마바사아"])
    own, asked = F.element_at(names, (k % 8 + 1).cast("int")), F.element_at(names, ((k * 5) % 8 + 1).cast("int"))
    said = F.concat(asked, F.lit(" "), num((k * 7) % 5 + 1), F.lit("장 "), num(F.lit(101) + (k * 13) % 149), F.lit(".의 1항\n"))
    body = F.when(k % 3 != 0, F.lit("1. 요건")).otherwise("2. 요건")
    made = articles(spark, sf_dir).withColumn("source_file", F.concat(F.lit("시험 "), own, F.lit("_2024"))).withColumn("content", F.concat(F.when(k % 6 == 3, said).otherwise(""), body))
    return ops.named_document_references(made).select("chunk_id", "target")


@query(f"""WITH {A}, n AS (SELECT a.chunk_id, min(t.chunk_id) FILTER (t.ch = a.ch) AS near, count(*) FILTER (t.ch = a.ch) AS n_near, min(t.chunk_id) AS wide, count(t.chunk_id) AS n FROM a LEFT JOIN a t ON t.part = a.part AND t.art = a.rart AND t.kind = 'rule' AND t.chunk_id <> a.chunk_id WHERE a.form = 5 GROUP BY a.chunk_id)
SELECT chunk_id, '에도 불구하고' AS marker, CASE WHEN n_near = 1 THEN near WHEN n_near = 0 AND n = 1 THEN wide END AS counterpart FROM n""")
def precedence_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.precedence(articles(spark, sf_dir)).select("chunk_id", "marker", "counterpart")


@query(f"""WITH {A}, d AS (SELECT part, k % 7 AS term, min(chunk_id) AS definition FROM a WHERE k % 17 = 0 AND kind = 'rule' GROUP BY ALL), u AS (SELECT a.chunk_id, d.term, d.definition, row_number() OVER (PARTITION BY a.chunk_id ORDER BY d.term DESC) AS r FROM a JOIN d ON d.part = a.part AND d.definition <> a.chunk_id AND (d.term = a.k % 7 OR d.term = (a.k + 3) % 7) WHERE a.k % 17 <> 0)
SELECT chunk_id, repeat('긴', CAST(term AS INT)) || '수밀구획' || term AS term, definition FROM u WHERE r = 1""")
def definition_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest defined term that an article uses; a term's length grows with its number."""
    term = lambda n: F.concat(F.expr(f"repeat('긴', cast({n} as int))"), F.lit("수밀구획"), F.expr(f"cast({n} as string)"))
    defines = F.concat(F.lit("“"), term("k % 7"), F.lit("”이란 구획을 말한다"))
    uses = F.concat(F.lit("<"), term("k % 7"), F.lit("> <"), term("(k + 3) % 7"), F.lit(">"))
    made = articles(spark, sf_dir).withColumn("content", F.when(F.col("k") % 17 == 0, defines).otherwise(uses))
    return ops.definition_links(made.where("k % 17 <> 0"), ops.defined_terms(made))


@query("""WITH a AS (SELECT p_partkey AS k, 'P' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS chunk_id FROM part) SELECT min(chunk_id) FILTER (k % 2 = 0) AS rule, min(chunk_id) FILTER (k % 2 = 1) AS guidance FROM a WHERE k % 6 <> 0 GROUP BY k // 2 HAVING count(*) = 2""")
def mirror_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two parts in a row as a rule and its guidance; every third pair lacks the rule."""
    half = F.floor(F.col("k") / 2).cast("string")
    made = articles(spark, sf_dir).where("k % 6 <> 0").withColumn("article_no", half).withColumn("source_file", F.lit("1편")).withColumn("chapter_no", F.lit("1")).withColumn("document_type", F.when(F.col("k") % 2 == 0, "rule").otherwise("guidance"))
    return ops.mirror_links(made)


ATOMS = """c AS (SELECT l_orderkey AS doc, l_linenumber AS o, l_orderkey || ':' || l_linenumber AS chunk_id, CASE WHEN l_linenumber % 3 = 1 THEN 'text' WHEN l_linenumber % 3 = 2 THEN 'table' ELSE 'figure' END AS t, min(l_suppkey) % 3 AS no, min(l_partkey) % 3 AS f, min(l_returnflag) AS seg FROM lineitem GROUP BY l_orderkey, l_linenumber),
atoms AS (SELECT doc, seg, t, no, min_by(chunk_id, o) AS atom FROM c WHERE t <> 'text' GROUP BY doc, seg, t, no)"""


@query(f"""WITH {ATOMS}, l AS (SELECT c.chunk_id, f.atom AS fig, t.atom AS tab FROM c LEFT JOIN atoms f ON f.doc = c.doc AND f.seg = c.seg AND f.t = 'figure' AND f.no = c.f LEFT JOIN atoms t ON t.doc = c.doc AND t.seg = c.seg AND t.t = 'table' AND t.no = c.no WHERE c.t = 'text')
SELECT chunk_id, coalesce(fig, '') AS figures, coalesce(tab, '') AS tables FROM l WHERE fig IS NOT NULL OR tab IS NOT NULL""")
def citation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as chunks of their order: texts cite a figure and a table by number, twice."""
    kind = F.when(F.col("l_linenumber") % 3 == 1, "text").when(F.col("l_linenumber") % 3 == 2, "table").otherwise("figure")
    no = (F.col("l_suppkey") % 3).cast("string")
    caption = F.when(F.col("l_linenumber") % 3 == 2, F.concat(F.lit("15 표 1."), no, F.lit(" 부재 치수"))).when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("Fig. 1."), no, F.lit(". plan")))
    cite = lambda t: F.struct(F.lit("x").alias("ref_type"), t.alias("target"))
    cited = F.array(cite(F.concat(F.lit("Figure 1."), (F.col("l_partkey") % 3).cast("string"))), cite(F.concat(F.lit("표 1."), no)), cite(F.concat(F.lit("그림 1."), (F.col("l_partkey") % 3).cast("string"))), cite(F.lit("1편 2장")))
    once = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in ("l_suppkey", "l_partkey", "l_returnflag")])
    chunks = once.select(F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("document_type"), F.concat("l_orderkey", F.lit(":"), "l_linenumber").alias("chunk_id"), F.col("l_linenumber").alias("chunk_order"), kind.alias("chunk_type"), caption.alias("caption"), cited.alias("references"))
    return ops.citation_links(chunks).select("chunk_id", F.array_join("linked_figure_chunk_ids", ",").alias("figures"), F.array_join("linked_table_chunk_ids", ",").alias("tables"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING max(l_quantity) > 45) AND o_orderstatus <> 'P' THEN 'parent' ELSE 'child' END AS chunk_level FROM orders""")
def promoted_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tables, their line items as rows if they are large and as notes if not: tables with rows become parents."""
    tables = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chunk_id"), F.when(F.col("o_orderstatus") == "P", "text").otherwise("table").alias("chunk_type"), F.lit(None).cast("long").alias("parent_chunk_id"), F.lit("child").alias("chunk_level"))
    rows = table(spark, sf_dir, "lineitem").select((-F.col("l_orderkey") * 10 - F.col("l_linenumber")).alias("chunk_id"), F.when(F.col("l_quantity") > 45, "table_row").otherwise("note").alias("chunk_type"), F.col("l_orderkey").alias("parent_chunk_id"), F.lit("child").alias("chunk_level"))
    return ops.promote_tables(tables.unionByName(rows)).where("chunk_id >= 0").select(F.col("chunk_id").alias("o_orderkey"), "chunk_level")


@query("""WITH l AS (SELECT conv_id, turn, text, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS total FROM conversations WHERE text <> ''), o AS (SELECT *, sum(CASE WHEN total > 500 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM l),
b AS (SELECT conv_id, string_agg(CASE WHEN total > 500 THEN '(more)' ELSE text END, chr(10) || chr(10) ORDER BY turn) AS block FROM o WHERE n <= 1 GROUP BY conv_id)
SELECT conv_id, 'Conversation ' || conv_id || chr(10) || chr(10) || '[Tables]' || chr(10) || block AS content FROM b""")
def attached_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with the texts that they link, up to a budget."""
    turns = table(spark, sf_dir, "conversations")
    blocks = turns.select(F.concat("conv_id", F.lit(":"), F.lpad("turn", 4, "0")).alias("chunk_id"), F.col("text").alias("block"))
    links = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.concat("conv_id", F.lit(":"), F.lpad("turn", 4, "0")))).alias("links"))
    parents = links.select(F.col("conv_id").cast("string").alias("chunk_id"), "links", F.concat(F.lit("Conversation "), "conv_id", F.lit("  ")).alias("content"))
    return ops.attach_blocks(parents, blocks, "links", "Tables", 500, "(more)").select(F.col("chunk_id").cast("long").alias("conv_id"), "content")


ROUTED = """f AS (SELECT p_partkey AS k, 'D' || p_partkey % 6 AS source_file, 'P' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS chunk_id, p_partkey % 5 AS term, p_partkey % 19 = 0 AS precedence, p_partkey % 7 = 0 AS def_link, p_partkey % 23 = 0 AS formula_calc, p_partkey % 29 = 0 AS figure_qa, p_partkey % 5 = 0 AS table_lookup, p_partkey % 3 = 0 AS hierarchy, p_partkey % 4 = 0 AS crossref FROM part)"""


@query(f"""WITH {ROUTED}, x AS (SELECT k, unnest(['precedence', 'def_link', 'formula_calc', 'figure_qa', 'table_lookup', 'hierarchy', 'crossref']) AS t, unnest([precedence, def_link, formula_calc, figure_qa, table_lookup, hierarchy, crossref]) AS has, unnest(range(7)) AS i FROM f),
c AS (SELECT t, i, count(*) FILTER (has) AS n FROM x GROUP BY t, i), r AS (SELECT t, row_number() OVER (ORDER BY n, i) AS rank FROM c), p AS (SELECT k, min_by(x.t, rank) FILTER (has) AS track, min_by(x.t, rank) FILTER (has AND x.t <> 'def_link') AS next FROM x JOIN r USING (t) GROUP BY k),
q AS (SELECT f.*, track, next, row_number() OVER (PARTITION BY source_file, term, track ORDER BY chunk_id) AS turn FROM f JOIN p USING (k))
SELECT chunk_id, coalesce(CASE WHEN track = 'def_link' AND turn > 2 THEN next ELSE track END, CASE WHEN ('0x' || right(sha256(source_file || '|' || chunk_id), 1))::INT % 2 = 0 THEN 'spec' ELSE 'applicability' END) AS track FROM q""")
def routed_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    every = dict(zip(ops.TRACKS, (19, 7, 23, 29, 5, 3, 4), strict=True))
    features = table(spark, sf_dir, "part").select(F.concat(F.lit("P"), F.lpad(k.cast("string"), 9, "0")).alias("chunk_id"), F.concat(F.lit("D"), k % 6).alias("source_file"), (k % 5).cast("string").alias("term"), *[(k % n == 0).alias(t) for t, n in every.items()])
    return ops.route_tracks(features).select("chunk_id", "track")


@query(f"""WITH {ROUTED}, x AS (SELECT k, unnest(['precedence', 'def_link', 'formula_calc', 'figure_qa', 'table_lookup', 'hierarchy', 'crossref']) AS t, unnest([precedence, def_link, formula_calc, figure_qa, table_lookup, hierarchy, crossref]) AS has, unnest(range(7)) AS i FROM f),
c AS (SELECT t, i, count(*) FILTER (has) AS n FROM x GROUP BY t, i), r AS (SELECT t, row_number() OVER (ORDER BY n, i) AS rank FROM c), p AS (SELECT k, min_by(x.t, rank) FILTER (has) AS track, min_by(x.t, rank) FILTER (has AND x.t <> 'def_link') AS next FROM x JOIN r USING (t) GROUP BY k),
q AS (SELECT f.*, track, next, row_number() OVER (PARTITION BY source_file, CASE WHEN def_link THEN term END, track ORDER BY chunk_id) AS turn FROM f JOIN p USING (k))
SELECT chunk_id, coalesce(CASE WHEN track = 'def_link' AND turn > 2 THEN next ELSE track END, CASE WHEN ('0x' || right(sha256(source_file || '|' || chunk_id), 1))::INT % 2 = 0 THEN 'spec' ELSE 'applicability' END) AS track FROM q""")
def texts_to_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From articles' texts to their tracks: parts as articles whose texts hold formulas, figures, tables and outlines by
    their keys, and define terms, cite others or precede them by tables of their own."""
    k = F.col("p_partkey")
    has = lambda n: k % n == 0
    body = F.concat_ws(
        "\n", F.lit("1. General"), F.when(has(3), F.lit("(1) first\n(가) leaf")).otherwise(F.lit("(1) only")), F.when(has(23), F.lit("$$ a + b = c $$")).otherwise(F.lit("$$ $$")),
        F.when(has(5), F.lit("[인용된 표] <table><tr><th>a</th><th>b</th></tr><tr></tr><tr></tr></table>")).otherwise(F.lit("[인용된 표] <table><tr><th>a</th></tr></table>")),
        F.when(has(29), F.concat(F.lit("[인용된 그림] "), F.repeat(F.lit("shape "), 12))).otherwise(F.lit("[인용된 그림] short")))
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("P"), F.lpad(k.cast("string"), 9, "0")).alias("chunk_id"), F.concat(F.lit("D"), k % 6).alias("source_file"), body.alias("content"), k.alias("k"))
    of = lambda n: parts.where(F.col("k") % n == 0)
    terms = of(7).select("chunk_id", (F.col("k") % 5).cast("string").alias("term"))
    features = probes.features(probes.probed(parts), of(19), terms, of(4))
    return ops.route_tracks(features).select("chunk_id", "track")


@query("""SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN NULL ELSE CAST(9 + p_partkey % 7 AS DOUBLE) END AS threshold, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'gte' WHEN 2 THEN 'gte' WHEN 3 THEN 'lt' ELSE 'gt' END AS op, CASE WHEN p_partkey % 5 <> 0 THEN CASE p_partkey % 2 WHEN 0 THEN 'mm' ELSE 'kg' END END AS unit,
CASE WHEN p_partkey % 5 <> 0 THEN CASE p_partkey % 2 WHEN 0 THEN '두께' ELSE '중량' END END AS quantity FROM part""")
def unit_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as clauses with a number and unit: a scope, a requirement, a denied limit, a limit after a permission, a sum."""
    k = F.col("p_partkey")
    value, unit, noun = (F.lit(9) + k % 7).cast("string"), F.when(k % 2 == 0, "mm").otherwise("kg"), F.when(k % 2 == 0, "두께").otherwise("중량")
    said = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    text = (
        F.when(k % 5 == 0, said(noun, "가 ", value, " ", unit, " 이하의 선박에 적용한다."))
        .when(k % 5 == 1, said("판의 ", noun, "는 ", value, " ", unit, " 이상이어야 한다."))
        .when(k % 5 == 2, said("그 ", noun, "는 ", value, " ", unit, " 미만이어서는 아니 된다."))
        .when(k % 5 == 3, said(noun, "가 5 t 이하일 때에는 생략할 수 있다.\n그 ", noun, "는 ", value, " ", unit, " 미만으로 한다."))
        .otherwise(said(noun, "는 다음 식에 의한 6 t 이상으로 한다.\n", noun, "는 ", value, " ", unit, " 초과로 한다."))
    )
    found = table(spark, sf_dir, "part").select(k.alias("id"), probes.unit_threshold(text).alias("t"))
    return found.select("id", F.col("t.threshold").alias("threshold"), F.col("t.op").alias("op"), F.col("t.unit").alias("unit"), F.col("t.quantity").alias("quantity"))


@query("""WITH k AS (SELECT doc_id AS d, 1 + doc_id % 9 AS p, 1 + doc_id % 7 AS c, 101 + doc_id % 800 AS a, 1 + doc_id % 6 AS i FROM documents),
t AS (SELECT d, unnest([CASE WHEN d % 3 = 0 THEN 'external_convention' END, 'internal_rule', 'internal_guidance', CASE WHEN d % 2 = 0 THEN 'table' END, 'figure', CASE WHEN d % 5 = 0 THEN 'internal_appendix' END]) AS ref_type,
 unnest(['SOLAS II-' || i || ' 및 그 밖', '규칙 ' || p || '편 ' || c || '장 ' || a || '.의 ' || i || '항', '지침 ' || c || '장 ' || (a + 1), '표 ' || c || '.' || i || '.' || p, '그림 ' || p || '.' || i, '부록 ' || p || '-' || i]) AS target FROM k)
SELECT d AS doc_id, ref_type, target, row_number() OVER (PARTITION BY d ORDER BY length(target) DESC, CASE ref_type WHEN 'external_convention' THEN 0 WHEN 'internal_appendix' THEN 1 WHEN 'internal_rule' THEN 2 WHEN 'internal_guidance' THEN 3 WHEN 'table' THEN 4 ELSE 5 END) - 1 AS pos FROM t WHERE ref_type IS NOT NULL""")
def cited_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with a text of references by its id, some twice and some within others."""
    d = F.col("doc_id")
    p, c, a, i = (F.col(n) for n in "pcai")
    said = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    text = F.concat_ws(
        ", ", F.when(d % 3 == 0, said("SOLAS II-", i, " 및 그 밖")), said("규칙  ", p, "편 ", c, "장 ", a, ".의 ", i, "항"), said(p, "편 ", c, "장 ", a, "."), said("지침 ", c, "장 ", a + 1, "."),
        F.when(d % 2 == 0, said("표 ", c, ".", i, ".", p)), said("그림 ", p, ".", i), F.when(d % 5 == 0, said("부록 ", p, "-", i)), said(a, ".의 ", i, "항"), said("그림 ", p, ".", i))
    rows = table(spark, sf_dir, "documents").select("doc_id", (1 + d % 9).alias("p"), (1 + d % 7).alias("c"), (101 + d % 800).alias("a"), (1 + d % 6).alias("i"))
    return rows.select("doc_id", F.posexplode(ops.cited(text)).alias("pos", "r")).select("doc_id", "r.ref_type", "r.target", F.col("pos").cast("long").alias("pos"))
