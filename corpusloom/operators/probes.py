"""What an article's text offers: outlines, formulas, figures, tables, thresholds with units; the features of routing."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

# Marks of an outline's levels, and of blocks that are appended to an article.
LEVELS = (r"^\s{0,3}(\d{1,2})\.\s", r"^\s{0,3}\((\d{1,2})\)\s?", r"^\s{0,3}\(([가-힣])\)\s?")
TABLE_BLOCK, FIGURE_BLOCK = "[인용된 표]", "[인용된 그림]"
LINE_CHARS, FORMULA_CHARS, FIGURE_CHARS, FIGURE_BLOCK_CHARS = 300, 5, 60, 2500
# Units with the unit to convert to; comparisons; nouns of quantities; how a number is a requirement's.
CONVERTED = {"mm": "m", "cm": "mm", "m": "mm", "kg": "t", "t": "kg", "kw": "mw", "mw": "kw", "w": "kw", "min": "sec", "sec": "min", "h": "min", "시간": "min"}
COMPARED = {"이상": "gte", "이하": "lte", "초과": "gt", "미만": "lt"}
OPPOSITE = {"lt": "gte", "lte": "gt", "gt": "lte", "gte": "lt"}
SAID = {"gte": "이상", "gt": "초과", "lte": "이하", "lt": "미만"}
UNIT_VALUE = r"([\d,]+(?:\.\d+)?)\s*(mm|cm|kW|MW|kg|min|sec|시간|t|m|W|h)(?![A-Za-z0-9²³/])\s*(이상|이하|초과|미만)"
QUANTITIES = "두께|길이|지름|직경|내경|외경|반지름|안지름|폭|너비|높이|깊이|간격|거리|크기|용량|출력|압력|온도|시간|중량|무게|하중|속도|면적|치수|스팬|피치|반경|파고|수두|틈새|간극"
BEFORE = r"([가-힣]{2,10}?)(?:으로|에서|에는|보다|의|은|는|이|가|을|를|도|로)?\s*$"
NEGATED = r"^\s*(?:이어서는|여서는|하여서는)?\s*(?:아니\s*된다|안\s*된다|아니된다|되지\s*않는다|불가하다)"
#: Reasons for which a number isn't a requirement's threshold: by what follows it, by its clause, by its sentence.
SCOPE_TAIL = r"^\s*(?:의|인)?\s*(?:선박|것|구조물|경우)"
CLAUSE_GUARDS = {
    "permission": r"할 수(?:도)? 있(?:다|으며|고|음)|하여도 좋|해도 좋|아니할 수 있|않을 수 있|준용할 수 있|생략할 수 있|무방하다",
    "classification": r"간주한다|간주된다|으로 본다|로 본다|분류한다",
    "cap": r"넘을 때에는|넘는 경우에는|넘을 필요는 없|넘는 때에는",
    "branch": r"(?:일 때|인 경우)\s*[:：]",
}
AREA, LENGTHS, BY_FORMULA = r"면적|단면적", ("mm", "cm", "m"), r"다음 ?식"
TAIL_CHARS, NEGATED_CHARS, AFTER_CHARS, BACK_CHARS = 12, 16, 14, 150
THRESHOLD = StructType().add("threshold", DoubleType())
for _name in ("unit", "op", "op_kr", "conv_unit", "rule_sentence", "quantity"):
    THRESHOLD = THRESHOLD.add(_name, StringType())


def outline_lines(articles: DataFrame, key: str = "chunk_id", text: str = "content") -> DataFrame:
    """(key, pos, line, l1, l2, l3): the lines of each article with the label of the level that they begin, if any."""
    lines = articles.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("pos", "line"))
    found = [F.nullif(F.regexp_extract("line", p, 1), F.lit("")) for p in LEVELS]
    return lines.select(key, "pos", "line", found[0].alias("l1"), F.when(found[0].isNull(), found[1]).alias("l2"), F.when(found[0].isNull() & found[1].isNull(), found[2]).alias("l3"))


def outline_leaves(articles: DataFrame, key: str = "chunk_id", text: str = "content") -> DataFrame:
    """(key, pos, first, second, third, line): the lines of the third level below one of the second and of the first,
    with their path. A line of the first level ends the second. Null texts have no lines."""
    over = lambda *more: Window.partitionBy(key, *more).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = outline_lines(articles, key, text).where("l1 IS NOT NULL OR l2 IS NOT NULL OR l3 IS NOT NULL")
    rows = rows.withColumn("scope", F.sum(F.col("l1").isNotNull().cast("int")).over(over()))
    rows = rows.withColumns({"first": F.last("l1", ignorenulls=True).over(over()), "second": F.last("l2", ignorenulls=True).over(over("scope"))})
    leaves = rows.where("l3 IS NOT NULL AND first IS NOT NULL AND second IS NOT NULL")
    return leaves.select(key, "pos", "first", "second", F.col("l3").alias("third"), F.left(F.trim("line"), F.lit(LINE_CHARS)).alias("line"))


def hierarchy(articles: DataFrame, key: str = "chunk_id", text: str = "content") -> DataFrame:
    """(key, depth, leaf_path, leaf_text): the first leaf of each article; of one with two lines or more of both upper
    levels but no leaf, the first of the second level with the line of the first level before it, or the first at all."""
    plain = articles.select(key, F.substring_index(F.coalesce(text, F.lit("")), TABLE_BLOCK, 1).alias("body"))
    leaves = outline_leaves(plain, key, "body").groupBy(key).agg(F.min_by(F.struct("first", "second", "third", "line"), "pos").alias("leaf"))
    along = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = outline_lines(plain, key, "body").where("l1 IS NOT NULL OR l2 IS NOT NULL").withColumn("owner", F.coalesce(F.last("l1", ignorenulls=True).over(along), F.lit("1")))
    two = marked.groupBy(key).agg(F.count("l1").alias("n1"), F.count("l2").alias("n2"), F.min_by(F.struct("owner", "l2", "line"), F.when(F.col("l2").isNotNull(), F.col("pos"))).alias("ho"))
    both = leaves.join(two, key, "full").where("leaf IS NOT NULL OR (n1 >= 2 AND n2 >= 2)")
    deep = F.col("leaf").isNotNull()
    path = F.when(deep, F.concat("leaf.first", F.lit("항 ("), "leaf.second", F.lit(")호 ("), "leaf.third", F.lit(")목"))).otherwise(F.concat("ho.owner", F.lit("항 ("), "ho.l2", F.lit(")호")))
    return both.select(key, F.when(deep, 3).otherwise(2).alias("depth"), path.alias("leaf_path"), F.coalesce("leaf.line", F.left(F.trim("ho.line"), F.lit(LINE_CHARS))).alias("leaf_text"))


def formulas(text: Column, most: int = 3) -> Column:
    """The first formulas between doubled dollar signs that hold something."""
    inside = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?s)\$\$(.+?)\$\$"), F.lit(1))
    kept = F.filter(inside, lambda f: F.length(F.trim(f)) >= FORMULA_CHARS)
    return F.slice(F.transform(kept, lambda f: F.concat(F.lit("$$"), f, F.lit("$$"))), 1, most)


def figure_block(text: Column) -> Column:
    """The figure block of an article, if its description is long enough; else null."""
    at = F.instr(text, FIGURE_BLOCK)
    block = F.substr(text, at, F.lit(FIGURE_BLOCK_CHARS))
    return F.when((at > 0) & (F.length(block) >= FIGURE_CHARS + len(FIGURE_BLOCK)), block)


def table_schema(text: Column) -> Column:
    """(n_rows, header_cells) of an article's table block with three rows or more and a header of two cells or more of
    which not more than three in ten are empty, its corner aside; else null."""
    body = F.substr(text, F.instr(text, TABLE_BLOCK) + len(TABLE_BLOCK))
    rows = F.split(body, "<tr")
    cells = F.transform(F.regexp_extract_all(F.coalesce(F.get(rows, F.lit(1)), F.lit("")), F.lit(r"(?s)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda c: F.trim(F.regexp_replace(c, "<[^>]+>", "")))
    core = F.when(F.size(cells) > 2, F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(1)))).otherwise(cells)
    empty = F.size(F.filter(core, lambda c: c.isin("", "()", "( )")))
    good = F.contains(text, F.lit(TABLE_BLOCK)) & (F.size(rows) - 1 >= 3) & (F.size(cells) >= 2) & (empty <= 0.3 * F.size(core))
    return F.when(good, F.struct((F.size(rows) - 1).alias("n_rows"), F.slice(cells, 1, 8).alias("header_cells")))


def clause(text: str, start: int, end: int) -> str:
    """The clause around a number: from the last line end or sentence end before it to the next one after."""
    low = max(text.rfind("\n", 0, start) + 1, text.rfind("다.", 0, start) + 2 if "다." in text[:start] else 0)
    ends = [p for p in (text.find("\n", end), text.find("다.", end) + 2 if "다." in text[end:] else -1) if p >= 0]
    return text[low : min(ends, default=len(text))]


def quantity(text: str, part: str, match: re.Match) -> str:
    """What is measured: the noun right before the number in its clause, else one right after it, else the last before."""
    found = re.search(BEFORE, part[: part.find(match.group(1))].rstrip())
    if found and re.search(f"(?:{QUANTITIES})$", found.group(1)):
        return found.group(1)
    if found := re.search(QUANTITIES, text[match.end() : match.end() + AFTER_CHARS]):
        return found.group()
    return (re.findall(QUANTITIES, text[max(0, match.start() - BACK_CHARS) : match.start()]) or [""])[-1]


def threshold_guards(text: str, match: re.Match) -> str | None:
    """Why a number with a unit isn't the threshold of a requirement; None if it is. Guards in order: what it is a scope
    of, what its clause says, several dimensions, two branches at the same value, no quantity, a formula."""
    number, unit, after = match.group(1), match.group(2).lower(), text[match.end() : match.end() + TAIL_CHARS]
    part = clause(text, match.start(), match.end())
    if re.match(SCOPE_TAIL, after):
        return "scope"
    for name, pattern in CLAUSE_GUARDS.items():
        if re.search(pattern, part):
            return name
    if unit in LENGTHS and re.search(AREA, part):
        return "area"
    if "×" in part or "x" in part.replace(match.group(), ""):
        return "dimensions"
    said = set(re.findall(rf"{re.escape(number)}\s*{re.escape(match.group(2))}\s*(이상|이하|초과|미만)", text))
    if {"이상", "이하"} <= said or {"초과", "미만"} <= said:
        return "branches"
    if not quantity(text, part, match):
        return "quantity"
    if re.search(BY_FORMULA, sentence(text, match)):
        return "formula"
    return None


def sentence(text: str, match: re.Match) -> str:
    end = text.find("\n", match.end())
    return text[text.rfind("\n", 0, match.start()) + 1 : end if end >= 0 else None].strip()[:LINE_CHARS]


def threshold(text: str) -> tuple | None:
    """The first threshold of a requirement in a text, as THRESHOLD."""
    for match in re.finditer(UNIT_VALUE, text):
        unit = match.group(2).lower()
        try:
            value = float(match.group(1).replace(",", ""))
        except ValueError:
            continue
        if unit not in CONVERTED or threshold_guards(text, match):
            continue
        op = COMPARED[match.group(3)]
        if re.match(NEGATED, text[match.end() : match.end() + NEGATED_CHARS]):
            op = OPPOSITE[op]
        return value, unit, op, SAID[op], CONVERTED[unit], sentence(text, match), quantity(text, clause(text, match.start(), match.end()), match)
    return None


@F.pandas_udf(THRESHOLD)
def _thresholds(texts: pd.Series) -> pd.DataFrame:
    found = [threshold(t) if t else None for t in texts]
    return pd.DataFrame([f or (None,) * len(THRESHOLD) for f in found], columns=THRESHOLD.names)


def unit_threshold(text: Column) -> Column:
    """THRESHOLD of a text's first threshold, null without any. Only texts with a number and unit leave the JVM."""
    some = F.when(text.rlike(UNIT_VALUE), text)
    found = F.when(some.isNotNull(), _thresholds(some))
    return F.when(found["threshold"].isNotNull(), found)


def probed(articles: DataFrame, key: str = "chunk_id", text: str = "content") -> DataFrame:
    """articles with formulas, figure_block, table_schema, unit_threshold and hierarchy (depth, leaf_path, leaf_text)."""
    deep = hierarchy(articles, key, text).select(key, F.struct("depth", "leaf_path", "leaf_text").alias("hierarchy"))
    c = F.col(text)
    return articles.withColumns({"formulas": formulas(c), "figure_block": figure_block(c), "table_schema": table_schema(c), "unit_threshold": unit_threshold(c)}).join(deep, key, "left")


def features(articles: DataFrame, precedence: DataFrame, definitions: DataFrame, references: DataFrame, key: str = "chunk_id") -> DataFrame:
    """What routing needs for each article: (key, source_file, term, a boolean for each track), from probed articles,
    and from what stands in the other tables: precedence (key), definitions (key, term), references (key)."""
    mark = lambda rows, name: rows.select(key, F.lit(True).alias(name)).distinct()
    terms = definitions.groupBy(key).agg(F.min("term").alias("term"))
    rows = articles.join(mark(precedence, "precedence"), key, "left").join(terms, key, "left").join(mark(references, "crossref"), key, "left")
    return rows.select(
        key, "source_file", "term", F.coalesce("precedence", F.lit(False)).alias("precedence"), F.col("term").isNotNull().alias("def_link"), (F.size("formulas") > 0).alias("formula_calc"), F.col("figure_block").isNotNull().alias("figure_qa"),
        F.col("table_schema").isNotNull().alias("table_lookup"), F.col("hierarchy").isNotNull().alias("hierarchy"), F.coalesce("crossref", F.lit(False)).alias("crossref"))
