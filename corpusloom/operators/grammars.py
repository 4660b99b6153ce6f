"""Articles of rule books from the blocks of their pages, by the own rules of seven families.

A heading holds until the next one of its level or above, so no parser walks a document: blocks are classed by
expressions, and windows over a document's blocks in order carry the segment, part, chapter, section and article. All
families go through the same windows in one pass, and a document's blocks are shuffled once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FAMILIES = ("kr", "nk", "lr", "dnv", "bv", "iacs", "abs")
LEVELS = ("segment", "part", "chapter", "section")
# Headings of each family as (level, kind, pattern); group 1 is the number, group 2 the title.
BANDS = {
    "kr": (("segment", "rule", r"^규칙\s*제\s*(\d+)\s*편(.*)$"), ("segment", "guidance", r"^지침\s*제\s*(\d+)\s*편(.*)$"), ("segment", "appendix", r"^부록\s*(\d+-\d+)(.*)$"), ("chapter", "", r"^제\s*(\d+)\s*장\s*(.*)$"), ("section", "", r"^제\s*(\d+(?:-\d+)?)\s*절\s*(.*)$")),
    "nk": (("segment", "guidance", r"(?i)^GUIDANCE\s+FOR\b()(.*)$"), ("segment", "rule", r"(?i)^(?:REGULATIONS|RULES)\s+FOR\b()(.*)$"), ("segment", "appendix", r"(?i)^Appendix\b()(.*)$"), ("chapter", "", r"(?i)^Chapter\s+(\d+)\s+(\S.*)$"), ("chapter", "", r"^[A-Z]{1,2}(\d+[A-Z]?)\s+(\S.*)$")),
    "lr": (("section", "", r"(?i)^Section\s+(\d+)\s+(\S.*)$"),),
    "dnv": (("section", "section", r"^SECTION\s+(\d+)\s+(\S.*)$"), ("section", "appendix", r"^APPENDIX\s+([A-Z0-9]+)\s+(\S.*)$")),
    "bv": (("part", "", r"(?i)^Part\s+([A-Z0-9]+)\s+(\S.*)$"), ("chapter", "", r"(?i)^Chapter\s+(\d+)\s+(\S.*)$"), ("section", "", r"(?i)^Section\s+(\d+)\s+(\S.*)$")),
    "iacs": (("chapter", "", r"(?i)^CHAPTER\s+(\d+)\s+(\S.*)$"), ("section", "", r"(?i)^SECTION\s+(\d+)\s+(\S.*)$")),
    "abs": (),
}
# An article's number and title.
ARTICLES = {
    "kr": (r"^(\d{3,4})\.\s*(\S.*)$",),
    "nk": (r"^(\d+\.\d+(?:\.\d+)?)\s+(\S.*)$", r"^[A-Z]{1,2}(\d+[A-Z]?\.\d+(?:\.\d+)?)\s+(\S.*)$"),
    "lr": (r"^(\d+\.\d+)\s+(\S.*)$",),
    "dnv": (r"^(\d+(?:\.\d+)*)\s+(\S.*)$",),
    "bv": (r"^\[?(\d+(?:\.\d+)*)\]?\s+(\S.*)$",),
    "iacs": (r"(?i)^(?:Regulations?|Reg\.?|Paragraphs?|Para\.?)\s+([IVXLC0-9][\w./\-]*)\s*(.*)$", r"^([A-Z]{0,4}\d+(?:\.\d+)*)\.?\s+(\S.*)$"),
    "abs": (r"^(\d+(?:\.\d+)*)\s+(\S.*)$",),
}
# Leaders of contents; what a family leaves out or takes away.
LEADER, KR_LEADER = r"\.{4,}|·{2,}", r"·{2,}|…|\.{4,}"
FRONT = ("class guideline", "foreword", "changes", "contents", "editorial corrections", "acknowledgement", "current")
WATERMARK = r"(?im)^.*(?:Taken from Regs4ships|Redistributed on behalf of the publisher|\bRegs4ships\b|r4s\.oneocean\.com).*$\n?"
CONTINUED = r"(?i)\s*\bNo\.?\s*\d+\s*\(\s*cont\.?\s*\)|(?<![A-Za-z])\s*\d+\s*\(\s*cont\.?\s*\)|\(\s*cont\.?\s*\)"
IACS_NOISE = r"(?i)^(?:No\.?\s*\d*\s*)?\(?\s*cont\.?\s*\)?$|^No\.$|^\d+$|^\(?\s*(?:Rev\.?\s*\d*|Corr\.?\s*\d*|Add\.?\s*\d*|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s*(?:19|20)?\d{2}|(?:19|20)\d{2})\s*\)?\s*$|^End of Document\.?\s*$"
NAMED = r"(?i)^(?:Regulations?|Interpretation|Arrangements?|Application|Scope|Approval|Notes?|General|Definitions?|Requirements?|Background|Introduction|Purpose|Recommendation|Guidance|Additional\b.*|Design\b.*|Testing\b.*)\s*[:.]?\s*$"
YEAR, STRAY, EFFECTIVE = r"^(?:19|20)\d{2}$", r"^\d{1,4}$", r"\s*\((\d{1,2}\s+\w+\s+\d{4})\)\s*$"
# Capitals drawn apart, running heads, decimal articles and their heads, titles' bands, contents tables.
SPACED, SPACED_WORDS = r"^((?:[A-Z]\s+){3,}[A-Z])(.*)$", r"(?i)^(?:SECTION|CHAPTER|PART|APPENDIX)"
RUNNING, INLINE = r"(?i)^(Section|Chapter|Appendix)\s+(\d+)\s+(.*?)\s+(?:\d+|A\d+)\s*$", r"(?i)^(SECTION|CHAPTER|APPENDIX)\s+(\d+)\s*(.*)$"
BAND_WORDS = ("SECTION", "CHAPTER", "APPENDIX", "PART")
DECIMAL, DECIMAL_SIGN, KR_HEAD, KR_SHORT_HEAD = r"^(\d+(?:\.\d+)*)\.?\s*(\S.*)?$", r"^\d+\.\d+", r"\d+\s*(?:편|부)", r"^\d+\s*(?:편|부)(?![0-9A-Za-z_가-힣])"
TITLE_PART, TITLE_CHAPTER, TITLE_SECTION = (rf"(?i) - {band}\s+([A-Z0-9]+)" for band in ("Part", "(?:Chapter|Volume)", "Section"))
CONTENTS, CELL, PAGE_TAIL = r"(?i)^(?:table of contents?|section\s+\d+|chapter\s+\d+|appendix\s+\d+)\b", r"(?is)<t[dh][^>]*>(.*?)</t[dh]>", r"\d{1,4}\s*$"
BODY = ("text", "ref_text", "list", "equation")
INLINE_CHARS, HEAD_CHARS, NAMED_CHARS, SLUG_CHARS, RELAXED_CHARS, CSR_BLOCKS = 80, 16, 60, 28, 60, 60


def of_family(parts: dict[str, Column], otherwise: Column | None = None) -> Column:
    """The family's own expression."""
    out = None
    for name, part in parts.items():
        out = F.when(F.col("family") == name, part) if out is None else out.when(F.col("family") == name, part)
    return out.otherwise(otherwise) if otherwise is not None else out


def despaced(text: Column) -> Column:
    """A heading's first word whose capitals are drawn apart, put together."""
    word = F.regexp_replace(F.regexp_extract(text, SPACED, 1), r"\s", "")
    return F.when(word.rlike(SPACED_WORDS), F.trim(F.concat(word, F.regexp_extract(text, SPACED, 2)))).otherwise(text)


def contents_table(caption: Column, html: Column) -> Column:
    """Whether a table is one of contents: named like a heading, and without cells or with two that end in a page."""
    cells = F.transform(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(CELL), F.lit(1)), lambda c: F.trim(F.regexp_replace(c, "<[^>]+>", " ")))
    return F.trim(F.coalesce(caption, F.lit(""))).rlike(CONTENTS) & ((F.size(cells) == 0) | (F.size(F.filter(cells, lambda c: c.rlike(PAGE_TAIL))) >= 2))


def _first_of(rules, build: Callable) -> Column:
    out = F.when(F.lit(False), build(rules[0]) if rules else F.lit(None)) if rules else None
    for rule in rules:
        out = out.when(F.col("t").rlike(rule[-1]), build(rule))
    return out


def _band(rule) -> Column:
    level, kind, pattern = rule
    return F.struct(F.lit(LEVELS.index(level)).alias("rank"), F.lit(kind).alias("kind"), F.regexp_extract("t", pattern, 1).alias("no"), F.trim(F.regexp_extract("t", pattern, 2)).alias("title"))


def _numbered(pattern: str) -> Column:
    return F.struct(F.regexp_extract("t", pattern, 1).alias("no"), F.trim(F.regexp_extract("t", pattern, 2)).alias("title"))


def page_heads(blocks: DataFrame) -> DataFrame:
    """blocks with `head` (kind, chapter, section): what the last running head of a page says, else of the pages before,
    else the first head of the document. Only kr and abs name their sections there."""
    t, typ = F.col("t"), F.col("type")
    number = lambda unit: F.regexp_extract("t", rf"(\d+)\s*{unit}", 1)
    korean = ((typ.isin("header", "footer") & t.rlike(KR_HEAD)) | ((typ == "text") & (F.length("t") < HEAD_CHARS) & t.rlike(KR_SHORT_HEAD))) & (number("장") != "")
    chapter = F.when(number("부") != "", F.concat(number("부"), F.lit("."), number("장"))).otherwise(number("장"))
    inline = (typ == "text") & F.col("level").isNotNull() & (F.length("t") < INLINE_CHARS) & t.rlike(INLINE)
    latin = lambda p: F.struct(F.lower(F.regexp_extract("t", p, 1)).alias("kind"), F.lit("").alias("chapter"), F.regexp_extract("t", p, 2).alias("section"))
    said = of_family({"kr": F.when(korean, F.struct(F.lit("rule").alias("kind"), chapter.alias("chapter"), number("절").alias("section"))), "abs": F.when((typ == "header") & t.rlike(RUNNING), latin(RUNNING)).when(inline, latin(INLINE))})
    rows = blocks.withColumn("said", said)
    doc = Window.partitionBy("doc_id")
    up_to_page = doc.orderBy("page").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last_said = lambda over: F.max_by(F.struct("page", "pos", "said"), F.when(F.col("said").isNotNull(), F.struct("page", "pos"))).over(over)["said"]
    first_said = F.min_by("said", F.when(F.col("said").isNotNull(), F.struct("page", "pos"))).over(doc)
    return rows.withColumn("head", F.coalesce(last_said(up_to_page), first_said)).drop("said")


def document_facts(blocks: DataFrame) -> DataFrame:
    """blocks with what holds for a whole document: decimal (kr), relaxed and title (lr), banded (nk, bv), csr (iacs)."""
    t, typ, doc = F.col("t"), F.col("type"), Window.partitionBy("doc_id")
    text, heading = typ == "text", F.col("level").isin(1, 2)
    any_of = lambda c: F.coalesce(F.max(c).over(doc), F.lit(False))
    count = lambda c: F.sum(c.cast("int")).over(doc)
    article = text & t.rlike(ARTICLES["kr"][0])
    is_band = lambda name, levels: text & levels & F.coalesce(F.exists(F.array(*[t.rlike(p) for _, _, p in BANDS[name]]), lambda x: x), F.lit(False))
    opening = text & (F.col("level") == 1) & (t.rlike(BANDS["nk"][0][2]) | t.rlike(BANDS["nk"][1][2]))
    rows = blocks.withColumns({"n_articles": count(article), "n_decimal": count(text & ~article & t.rlike(DECIMAL_SIGN)), "nth": F.row_number().over(doc.orderBy("pos"))})
    csr = text & (F.col("nth") <= CSR_BLOCKS) & (F.contains(F.lower("t"), F.lit("common structural rules")) | t.rlike(r"(?i)^PART\s+\d+\s+\S"))
    return rows.select(
        *blocks.columns,
        ((F.col("family") == "kr") & (F.col("n_articles") < 3) & (F.col("n_decimal") > F.greatest(F.lit(10), 3 * F.col("n_articles")))).alias("decimal"),
        (~any_of((F.col("level") == 2) & t.rlike(ARTICLES["lr"][0]))).alias("relaxed"), any_of(of_family({"nk": opening, "bv": is_band("bv", heading)})).alias("banded"), any_of(csr).alias("csr"),
        F.min_by("t", F.when(text & (F.col("level") == 1), F.col("pos"))).over(doc).alias("book_title"))


def placed_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks of the bodies with unit (of blocks under one heading), segment, part_no, chapter_no, section_no, article_no,
    article_title, marked, effective_date, opened (the block is its article's heading), keeps (a block of text)."""
    raw = F.trim(F.coalesce("text", F.lit("")))
    clean = F.trim(F.regexp_replace(of_family({"lr": F.regexp_replace(raw, WATERMARK, ""), "abs": despaced(raw)}, raw), r"^\n+|\n+$", ""))
    optional = {c: F.lit(None).cast("string") for c in ("html", "caption") if c not in blocks.columns}
    rows = blocks.withColumns(optional).select("doc_id", "family", "pos", F.coalesce("page", F.lit(0)).alias("page"), "type", "level", "html", "caption", clean.alias("t"))
    rows = document_facts(page_heads(rows)).where(F.col("type").isin(*BODY, "table", "image", "chart"))
    t, typ, fam, level = F.col("t"), F.col("type"), F.col("family"), F.col("level")
    told = typ.isin("text", "ref_text")

    inline_band = (t.rlike(INLINE) & (F.length("t") < INLINE_CHARS)) | F.upper("t").isin(*BAND_WORDS)
    noise = (t == "") | t.rlike(LEADER)
    noise = of_family({"kr": noise | t.rlike(KR_LEADER) | (F.col("decimal") & t.rlike(KR_SHORT_HEAD) & (F.length("t") < HEAD_CHARS)), "lr": noise | (told & level.eqNullSafe(1)), "dnv": noise | F.lower("t").isin(*FRONT), "abs": noise | (told & inline_band)}, noise)
    rows = rows.where(F.when(typ.isin(*BODY), ~noise).when(typ == "table", ~((fam == "bv") & contents_table(F.col("caption"), F.col("html")))).otherwise(True))

    heading = (typ == "text") & level.isin(1, 2)
    bands = {name: _first_of(rules, _band) for name, rules in BANDS.items() if rules}
    bands["kr"] = F.when((typ == "text") & ~F.col("decimal") & (level.isin(1, 2) | t.rlike(BANDS["kr"][0][2]) | t.rlike(BANDS["kr"][1][2])), bands["kr"])
    letters = BANDS["nk"][:3]
    bands["nk"] = F.when(heading & (level == 1), bands["nk"]).when(heading & ~F.exists(F.array(*[t.rlike(p) for _, _, p in letters]), lambda x: x), bands["nk"])
    bands["lr"], bands["iacs"] = F.when(told & (level == 2), bands["lr"]), F.when(told & F.col("csr"), bands["iacs"])
    bands["dnv"], bands["bv"] = F.when(heading, bands["dnv"]), F.when(heading, bands["bv"])
    along = Window.partitionBy("doc_id").orderBy("pos")
    so_far = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    paged = of_family({"abs": F.col("head"), "kr": F.when(F.col("decimal"), F.col("head"))})
    rows = rows.withColumns({"band": of_family(bands), "paged": paged})
    turned = F.coalesce(~F.lag("paged").over(along).eqNullSafe(F.col("paged")) & F.col("paged").isNotNull(), F.lit(False))
    upper = {f"above_{k}": F.coalesce(F.sum((F.col("band.rank") < k).cast("int")).over(so_far), F.lit(0)) for k in range(1, len(LEVELS))}
    rows = rows.withColumns({"turned": turned, "above_0": F.lit(0), **upper})
    rows = rows.withColumns({f"last_{k}": F.last(F.when(F.col("band.rank") == k, F.struct(F.col(f"above_{k}").alias("above"), F.col("band.kind").alias("kind"), F.col("band.no").alias("no"))), True).over(so_far) for k in range(len(LEVELS))})
    rows = rows.withColumn("scope", F.coalesce(F.sum((F.col("band").isNotNull() | F.col("turned")).cast("int")).over(so_far), F.lit(0)))
    here = lambda k, field: F.when(F.col(f"last_{k}.above") == F.col(f"above_{k}"), F.col(f"last_{k}.{field}"))
    hint = lambda pattern: F.when(fam == "lr", F.nullif(F.regexp_extract(F.coalesce("book_title", F.lit("")), pattern, 1), F.lit("")))
    kind = of_family({"dnv": here(3, "kind"), "abs": F.coalesce("paged.kind", F.lit("section")), "kr": F.coalesce(here(0, "kind"), F.lit("rule")), "nk": F.coalesce(here(0, "kind"), F.lit("rule"))}, F.lit(""))
    section = F.coalesce(F.col("paged.section"), here(3, "no"), hint(TITLE_SECTION), F.when(fam.isin("lr", "abs"), "1"), F.lit(""))
    rows = rows.withColumns({"segment": kind, "part_no": F.coalesce(here(1, "no"), hint(TITLE_PART), F.lit("")), "chapter_no": F.coalesce(F.col("paged.chapter"), here(2, "no"), F.when((fam == "kr") & (here(0, "kind") == "appendix"), here(0, "no")), hint(TITLE_CHAPTER), F.lit("")), "section_no": section})

    plain = {name: F.when(told & (level == 2), _first_of([(p,) for p in ps], lambda r: _numbered(r[0]))) for name, ps in ARTICLES.items()}
    plain["kr"] = F.when(F.col("decimal"), F.when(told & (level == 2) & t.rlike(DECIMAL), _numbered(DECIMAL))).otherwise(F.when(told & level.isin(1, 2) & t.rlike(ARTICLES["kr"][0]), _numbered(ARTICLES["kr"][0])))
    clause = _numbered(ARTICLES["lr"][0])
    relaxed = told & F.col("relaxed") & (F.substring_index(F.regexp_extract("t", r"^(\d+\.\d+)\s+\S", 1), ".", 1) == F.col("section_no")) & (F.col("section_no") != "")
    opening = F.struct(F.regexp_extract("t", r"^(\d+\.\d+)\s+\S", 1).alias("no"), F.left(F.trim(F.regexp_extract("t", r"^\d+\.\d+\s+([^\n]*)", 1)), F.lit(RELAXED_CHARS)).alias("title"))
    plain["lr"] = F.when(told & (level == 2) & t.rlike(ARTICLES["lr"][0]), clause).when(relaxed, opening)
    slug = F.left(F.regexp_replace(F.regexp_replace("t", "[^A-Za-z0-9]+", "-"), "^-+|-+$", ""), F.lit(SLUG_CHARS))
    numbered = F.regexp_extract("t", ARTICLES["iacs"][1], 1)
    named = told & (level == 2) & t.rlike(NAMED) & (F.length("t") < NAMED_CHARS)
    plain["iacs"] = F.when(told & (level == 2) & t.rlike(ARTICLES["iacs"][0]), _numbered(ARTICLES["iacs"][0])).when(numbered.rlike(YEAR), F.lit(None)).when(told & (level == 2) & t.rlike(ARTICLES["iacs"][1]), _numbered(ARTICLES["iacs"][1])).when(named, F.struct(slug.alias("no"), F.regexp_replace("t", r"[:.\s]+$", "").alias("title")))
    rows = rows.withColumn("art", F.when(F.col("band").isNull(), of_family(plain)))
    # A number with a bracket behind it is a running head; short heads, dates and the like are no text of iacs.
    running = (fam == "iacs") & (F.col("art.title").startswith("(") | (F.col("art").isNull() & told & t.rlike(IACS_NOISE)))
    rows = rows.where(F.col("band").isNotNull() | ~F.coalesce(running, F.lit(False))).where(~((fam == "abs") & told & t.rlike(STRAY)))

    opens = F.col("band").isNotNull() | F.col("turned") | F.col("art").isNotNull()
    latest = F.last(F.when(F.col("art").isNotNull(), F.struct("scope", "art.no", "art.title")), True).over(so_far)
    seen = lambda c: F.coalesce(F.sum(c.cast("int")).over(so_far), F.lit(0)) > 0
    started = of_family({"dnv": seen(F.col("band").isNotNull()), "bv": ~F.col("banded") | seen(F.col("band").isNotNull()), "nk": ~F.col("banded") | seen(F.col("band.rank") == 0), "abs": seen(F.col("art").isNotNull())}, F.lit(True))
    rows = rows.withColumns({"unit": F.sum(opens.cast("int")).over(so_far), "latest": latest, "started": started}).where("started")
    mine = F.col("latest.scope") == F.col("scope")
    title = F.when(mine, F.col("latest.title"))
    bare = of_family({"nk": F.regexp_replace(title, r"[\s*]+$", ""), "abs": F.regexp_replace(title, EFFECTIVE, "")}, title)
    body = of_family({"iacs": F.trim(F.regexp_replace(F.regexp_replace("t", CONTINUED, " "), r"[ \t]{2,}", " "))}, t)
    is_head = F.col("band").isNotNull() | (F.col("art").isNotNull() & ~((fam == "lr") & ~(F.coalesce(level, F.lit(0)) == 2)))
    return rows.select(
        "doc_id", "family", "pos", "page", "type", "unit", "segment", "part_no", "chapter_no", "section_no", F.coalesce(F.when(mine, F.col("latest.no")), F.lit("")).alias("article_no"), F.coalesce(bare, F.lit("")).alias("article_title"),
        ((fam == "nk") & F.coalesce(title, F.lit("")).rlike(r"\*\s*$")).alias("marked"), F.when(fam == "abs", F.nullif(F.regexp_extract(title, EFFECTIVE, 1), F.lit(""))).alias("effective_date"),
        F.col("art").isNotNull().alias("opened"), (F.col("type").isin(*BODY) & ~is_head & (body != "")).alias("keeps"), body.alias("text"))


def family_articles(blocks: DataFrame) -> DataFrame:
    """One row for each article of each document: doc_id, article_id, family, segment, part_no, chapter_no, section_no,
    article_no, article_title, marked, effective_date, first_pos, n_tables, n_figures, text.

    blocks: doc_id, family (of FAMILIES), pos (order in the document), page, type, level (of a heading, else null), text;
    html and caption of tables if there are. What stands before the first article of a section is one of its own,
    without a number. A heading without anything below it gives no row, but in bv, where one that no deeper heading
    follows is its own text. Ids repeat the place; later ones of the same place end in ~2, ~3 and so on. Null texts
    count as empty, null pages as page 0; blocks of other families and other columns are left out.
    """
    rows = placed_blocks(blocks.where(F.col("family").isin(*FAMILIES)))
    texts = F.array_sort(F.collect_list(F.when(F.col("keeps"), F.struct("pos", "text"))))
    kinds = {"n_tables": F.count_if(F.col("type") == "table"), "n_figures": F.count_if(F.col("type").isin("image", "chart"))}
    place = ["segment", "part_no", "chapter_no", "section_no", "article_no", "article_title", "marked", "effective_date"]
    units = rows.groupBy("doc_id", "unit").agg(F.first("family").alias("family"), *[F.first(c).alias(c) for c in place], F.max("opened").alias("opened"), F.min("pos").alias("first_pos"), *[c.alias(n) for n, c in kinds.items()], F.array_join(F.transform(texts, lambda x: x["text"]), "\n").alias("text"))
    along = Window.partitionBy("doc_id").orderBy("unit")
    empty = (F.col("text") == "") & (F.col("n_tables") + F.col("n_figures") == 0)
    below = F.coalesce(F.lead(F.when(F.col("opened"), F.col("article_no"))).over(along), F.lit("")).startswith(F.concat("article_no", F.lit(".")))
    leaf = (F.col("family") == "bv") & F.col("opened") & empty & ~below
    rows = units.withColumn("text", F.when(leaf, F.concat_ws(" ", "article_no", "article_title")).otherwise(F.col("text"))).withColumn("keep", ~empty | leaf).where("keep")
    path = F.concat_ws("/", F.col("doc_id").cast("string"), *[F.when(F.col(c) != "", F.concat(F.lit(sign), F.col(c))) for c, sign in (("segment", ""), ("part_no", "P"), ("chapter_no", "C"), ("section_no", "S"))], F.concat(F.lit("A"), F.when(F.col("article_no") == "", "INTRO").otherwise(F.col("article_no"))))
    rows = rows.withColumn("place", path).withColumn("again", F.row_number().over(Window.partitionBy("doc_id", "place").orderBy("unit")))
    article_id = F.when(F.col("again") > 1, F.concat_ws("~", "place", F.col("again").cast("string"))).otherwise(F.col("place"))
    return rows.select("doc_id", article_id.alias("article_id"), "family", *place, "first_pos", *kinds, "text")


def mirrored_articles(articles: DataFrame) -> DataFrame:
    """(doc_id, article_id, mirror_id) both ways: articles of rules and of guidance at the same chapter, section and number
    of a document. Of several at one place the last counts; articles without a number have no mirror."""
    key = ["doc_id", "chapter_no", "section_no", "article_no"]
    last = lambda kind: articles.where((F.col("segment") == kind) & (F.col("article_no") != "")).groupBy(*key).agg(F.max_by("article_id", "first_pos").alias(kind))
    pairs = last("rule").join(last("guidance"), key)
    ways = F.explode(F.array(F.struct(F.col("rule").alias("article_id"), F.col("guidance").alias("mirror_id")), F.struct(F.col("guidance").alias("article_id"), F.col("rule").alias("mirror_id"))))
    return pairs.select("doc_id", ways.alias("way")).select("doc_id", "way.article_id", "way.mirror_id")
