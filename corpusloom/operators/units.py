"""Articles of rule books into paragraphs, items and sub-items, by the order in which numbering styles appear.

No style has a depth of its own: within a paragraph the first style that appears marks items, another one below an
item marks its sub-items, any further one lies below those. What has been seen so far is carried by running windows
over an article's pieces, so an article of any length is sorted and read once and never held as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Styles of numbering with their marks, Roman numerals before single letters; a letter with a point
# needs a word after it. Paragraphs by a decimal or a bare number; labels of notes.
ROMAN = "i|ii|iii|iv|v|vi|vii|viii|ix|x"
STYLES = (
    ("paren_num", r"^\(\d{1,2}\)\s"),
    ("paren_roman", rf"(?i)^\((?:{ROMAN})\)\s"),
    ("paren_alpha", r"^\([a-z]\)\s"),
    ("paren_kr", r"^\([가-힣]\)\s"),
    ("num_paren", r"^\d{1,2}\)\s"),
    ("roman_paren", rf"(?i)^(?:{ROMAN})\)\s"),
    ("alpha_paren", r"^[a-z]\)\s"),
    ("roman_dot", rf"^(?:{ROMAN})\.\s+[A-Za-z]"),
    ("alpha_dot", r"^[a-z]\.\s+[A-Za-z]"),
)
DECIMAL = r"^(?:\d+\.\d+(?:\.\d+)*\s+\S|\d+\.\s+[A-Z])"
BARE = r"^\d{1,2}\s+[A-Za-z가-힣]"
NOTE = r"(?i)^Notes?\s*[:.]"
TITLE_CHARS = 70


def enumeration_style(text: Column) -> Column:
    """The name of the style whose mark a text begins with; null for dashes and running text."""
    out = F.when(text.rlike(STYLES[0][1]), STYLES[0][0])
    for name, pattern in STYLES[1:]:
        out = out.when(text.rlike(pattern), name)
    return out


def first_token(text: Column) -> Column:
    return F.regexp_extract(text, r"^(\S*)", 1)


def title(text: Column) -> Column:
    """The first line without its number."""
    return F.substring(F.trim(F.regexp_replace(F.regexp_extract(text, r"^([^\n]*)", 1), r"^\S+\s*", "")), 1, TITLE_CHARS)


def resolve_units(pieces: DataFrame, article: list[str], order: str = "pos", text: str = "text", page: str | None = None, decimal: str = DECIMAL, bare: str = BARE) -> DataFrame:
    """The article's columns, unit (from 1), heading, para_no, para_title, item_no, sub_item_no, text, first_piece
    (the place of its first piece in the article, from 0), n_pieces and, with `page`, pages: a row for each unit.

    A piece that matches `decimal` or `bare` begins a paragraph. After a note's label a bare number is a footnote, an
    item of paragraph "Note", until the next decimal number. A label is no unit: its text goes to the front of the
    unit that follows it, or stands alone at the article's end. Pieces without a mark belong to the unit before them.
    A deeper number is "sub-item.number". Pieces of equal order count as they come; null texts as empty; an empty table gives no units.
    """
    p = pieces.select(*article, F.col(order).alias("o"), F.coalesce(F.col(text), F.lit("")).alias("t"), *([F.col(page).alias("page")] if page else []))
    p = p.withColumn("place", F.row_number().over(Window.partitionBy(*article).orderBy("o")) - 1).drop("o")
    along, before = (Window.partitionBy(*article).orderBy("place").rowsBetween(Window.unboundedPreceding, k) for k in (0, -1))
    p = p.withColumns({"note": F.col("t").rlike(NOTE), "hard": F.col("t").rlike(decimal), "bare": F.col("t").rlike(bare), "token": first_token(F.col("t"))})
    p = p.withColumn("hard", F.col("hard") & ~F.col("note")).withColumn("bare", F.col("bare") & ~F.col("note") & ~F.col("hard"))
    p = p.withColumn("in_note", F.coalesce(F.last(F.when(F.col("note") | F.col("hard"), F.col("note")), ignorenulls=True).over(before), F.lit(False)))
    p = p.withColumns({"para": F.col("hard") | (F.col("bare") & ~F.col("in_note")), "foot": F.col("bare") & F.col("in_note"), "after_note": F.coalesce(F.lag("note").over(Window.partitionBy(*article).orderBy("place")), F.lit(True))})
    p = p.withColumn("style", F.when(~(F.col("note") | F.col("para") | F.col("foot")), enumeration_style(F.col("t"))))
    p = p.withColumn("scope", F.sum((F.col("note") | F.col("para")).cast("int")).over(along))

    inside = lambda *keys: Window.partitionBy(*article, *keys).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    scope = inside("scope")
    number = lambda flag: F.sum(flag.cast("int")).over(scope)
    p = p.withColumn("item", F.coalesce(F.col("style") == F.first("style", ignorenulls=True).over(scope), F.lit(False)))
    p = p.withColumns({"items": number(F.col("item")), "resets": number(F.col("item") | F.col("foot")), "cur_item": F.last(F.when(F.col("item") | F.col("foot"), F.col("token")), ignorenulls=True).over(scope)})
    p = p.withColumns({"scope_note": F.first("note").over(scope), "scope_para": F.first(F.when(F.col("para"), F.col("token"))).over(scope), "scope_title": F.first(F.when(F.col("para"), title(F.col("t")))).over(scope)})
    below = F.col("style").isNotNull() & ~F.col("item")
    p = p.withColumn("sub", F.coalesce(below & (F.col("style") == F.first(F.when(below, F.col("style")), ignorenulls=True).over(inside("scope", "items"))), F.lit(False)))
    p = p.withColumn("cur_sub", F.last(F.when(F.col("sub"), F.col("token")), ignorenulls=True).over(inside("scope", "resets")))

    starts = F.col("para") | F.col("foot") | F.col("style").isNotNull() | (F.col("after_note") & ~F.col("note"))
    p = p.withColumn("starts", starts).withColumn("unit", F.sum(F.col("starts").cast("int")).over(along) + F.col("note").cast("int"))
    para_no = F.when(F.col("scope_note"), "Note").otherwise(F.coalesce(F.regexp_replace("scope_para", r"\.+$", ""), F.lit("")))
    marked = F.col("foot") | F.col("style").isNotNull()
    sub_item = F.when(F.col("sub"), F.col("token")).when(F.col("style").isNotNull() & ~F.col("item"), F.concat_ws(".", "cur_sub", "token")).otherwise("")
    facts = F.struct(
        F.when(F.col("para"), para_no).when(marked, F.col("token")).otherwise("").alias("heading"), para_no.alias("para_no"), F.when(F.col("scope_note"), "Note").otherwise(F.coalesce("scope_title", F.lit(""))).alias("para_title"),
        F.when(marked, F.coalesce("cur_item", F.lit(""))).otherwise("").alias("item_no"), sub_item.alias("sub_item_no"), F.col("place").alias("first_piece"))
    lone = F.struct(F.lit("").alias("heading"), F.lit("Note").alias("para_no"), F.lit("Note").alias("para_title"), F.lit("").alias("item_no"), F.lit("").alias("sub_item_no"), (F.max("place") + 1).alias("first_piece"))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "t"))), lambda x: x["t"]), "\n")
    pages = [F.array_sort(F.collect_set("page")).alias("pages")] if page else []
    units = p.groupBy(*article, "unit").agg(F.coalesce(F.first(F.when(F.col("starts"), facts), ignorenulls=True), lone).alias("f"), texts.alias("text"), F.count("*").alias("n_pieces"), *pages)
    return units.select(*article, "unit", *[f"f.{c}" for c in ("heading", "para_no", "para_title", "item_no", "sub_item_no")], "text", "f.first_piece", "n_pieces", *(["pages"] if page else []))
