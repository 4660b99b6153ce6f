"""Articles of seven families of rule books. The supplied documents have no headings: each line gets those of a family by its document and place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import grammars as ops
from corpusloom.plans.registry import query, table


def family_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as blocks of a book of the family of their number: four lines a chapter or section, an article each, and
    after each eight lines the other segment."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    b, k = (F.floor(F.col("i") % 8 / 4) + 1).cast("string"), (F.col("i") % 4 + 1).cast("string")
    lines = lines.select("doc_id", "i", "line", b.alias("b"), k.alias("k"), F.floor(F.col("i") / 4).cast("int").alias("page"), F.get(F.array(*[F.lit(f) for f in ops.FAMILIES]), (F.col("doc_id") % 7).cast("int")).alias("family"))
    said = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.col(p) if p in "bk" else F.lit(p) for p in parts])
    block = lambda when, text, level=None, kind="text": F.when(when, F.struct(text.alias("text"), F.lit(level).cast("int").alias("level"), F.lit(kind).alias("type")))
    start, turn, first, each = F.col("i") == 0, (F.col("i") > 0) & (F.col("i") % 8 == 0), F.col("k") == "1", F.lit(True)
    guide = F.floor(F.col("i") / 8) % 2 == 1
    body = block(each, said("w ", F.col("line")))
    books = {
        "kr": [block(start | turn, F.when(guide, "지침 제 2 편").otherwise("규칙 제 2 편")), block(first, said("제 ", "b", " 장 총칙"), 1), block(each, said("10", "k", ". 제목"), 2), body],
        "nk": [block(start | turn, F.when(guide, "GUIDANCE FOR SHIPS").otherwise("RULES FOR SHIPS"), 1), block(first, said("Chapter ", "b", " General"), 1), block(each, said(F.when(guide, "K").otherwise(""), "b", ".", "k", " Title*"), 2), body],
        "lr": [block(start, F.lit("LR-RU-007 Rules - Part 3 Ship - Chapter 2 Hull - Section 1 Steel"), 1), block(first, said("Section ", "b", " Name"), 2), block(each, said("b", ".", "k", " Title"), 2), block(each, said("w ", F.col("line"), "\nTaken from Regs4ships"))],
        "dnv": [block(start, F.lit("FOREWORD"), 2), block(start, F.lit("before")), block(first, said("SECTION ", "b", " NAME"), 1), block(each, said("k", " Title"), 2), body],
        "bv": [block(start, F.lit("Part A Ships"), 1), block(first, said("Chapter ", "b", " Hull"), 1), block(each, said("[", "k", "] Title"), 2), body],
        "iacs": [block(each, said("G", "b", ".", "k", " Title"), 2), block(each, F.lit("52 (cont)")), body],
        "abs": [block(start, F.lit("before")), block(each, said("k", " Title (1 June 2025)"), 2), body, block(first, said("Section ", "b", " Name 7"), kind="header")],
    }
    blocks = ops.of_family({name: F.array_compact(F.array(*parts)) for name, parts in books.items()})
    rows = lines.select("doc_id", "family", "page", "i", F.posexplode(blocks).alias("j", "block"))
    return rows.select("doc_id", "family", (F.col("i") * 8 + F.col("j")).alias("pos"), "page", "block.*")


#: The same by arithmetic.
PLACED = rf"""l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i, unnest(string_split(text, chr(10))) AS line FROM documents),
x AS (SELECT doc_id, i, ([{", ".join(f"'{f}'" for f in ops.FAMILIES)}])[1 + doc_id % 7] AS family, CAST(i % 8 // 4 + 1 AS VARCHAR) AS b, CAST(i % 4 + 1 AS VARCHAR) AS k, CASE WHEN i // 8 % 2 = 1 THEN 'guidance' ELSE 'rule' END AS half, rtrim('w ' || line) AS t FROM l),
y AS (SELECT doc_id, i, family, CASE WHEN family IN ('kr', 'nk') THEN half WHEN family IN ('dnv', 'abs') THEN 'section' ELSE '' END AS segment, CASE family WHEN 'lr' THEN '3' WHEN 'bv' THEN 'A' ELSE '' END AS part_no, CASE WHEN family IN ('kr', 'nk', 'bv') THEN b WHEN family = 'lr' THEN '2' ELSE '' END AS chapter_no,
   CASE WHEN family IN ('lr', 'dnv', 'abs') THEN b ELSE '' END AS section_no, CASE family WHEN 'kr' THEN '10' || k WHEN 'nk' THEN b || '.' || k WHEN 'lr' THEN b || '.' || k WHEN 'iacs' THEN 'G' || b || '.' || k ELSE k END AS article_no, CASE family WHEN 'kr' THEN '제목' ELSE 'Title' END AS article_title,
   family = 'nk' AS marked, CASE family WHEN 'abs' THEN '1 June 2025' END AS effective_date, CASE family WHEN 'iacs' THEN regexp_replace(t, '[ \t]{{2,}}', ' ', 'g') ELSE t END AS text FROM x WHERE NOT regexp_matches(t, '\.{{4,}}|·{{2,}}') AND NOT (family = 'kr' AND contains(t, '…'))),
z AS (SELECT *, concat_ws('/', CAST(doc_id AS VARCHAR), nullif(segment, ''), 'P' || nullif(part_no, ''), 'C' || nullif(chapter_no, ''), 'S' || nullif(section_no, ''), 'A' || article_no) AS place FROM y),
a AS (SELECT *, place || CASE WHEN row_number() OVER w > 1 THEN '~' || row_number() OVER w ELSE '' END AS article_id FROM z WINDOW w AS (PARTITION BY doc_id, place ORDER BY i))"""


@query(f"WITH {PLACED} SELECT doc_id, article_id, segment, part_no, chapter_no, section_no, article_no, article_title, marked, effective_date, md5(text) AS text_md5 FROM a")
def family_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The articles of each document as a book of its family."""
    rows = ops.family_articles(family_blocks(spark, sf_dir))
    return rows.select("doc_id", "article_id", "segment", "part_no", "chapter_no", "section_no", "article_no", "article_title", "marked", "effective_date", F.md5("text").alias("text_md5"))


@query(f"""WITH {PLACED}, s AS (SELECT doc_id, chapter_no, section_no, article_no, max_by(article_id, i) FILTER (segment = 'rule') AS r, max_by(article_id, i) FILTER (segment = 'guidance') AS g FROM a GROUP BY ALL)
SELECT doc_id, r AS article_id, g AS mirror_id FROM s WHERE r IS NOT NULL AND g IS NOT NULL UNION ALL SELECT doc_id, g, r FROM s WHERE r IS NOT NULL AND g IS NOT NULL""")
def mirrored_family_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of rules and of guidance at the same place of a document."""
    return ops.mirrored_articles(ops.family_articles(family_blocks(spark, sf_dir)))
