"""References between articles: chapter-prefixed, bare, guidance, cross-document, named; definitions, precedence,
mirrors, citations of tables and figures; routing of articles to tracks.

articles: chunk_id, source_file, document_type (rule or guidance), chapter_no, article_no, article_title, content,
and where they have them section_no and references (array of struct ref_type, target).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.retrieval import capped_concat

# How references, definitions and precedence are written; words that are no terms or say nothing.
CHAPTER_REF = r"((?<![가-힣])지침\s*|[가-힣]*(?:규칙|기준|지침)\s*)?(?:(\d{1,2})\s*편\s*)?(\d{1,2})\s*장\s*(\d{3,4})\.(?:의\s*(\d+)\s*항)?"
BARE_REF = r"((?:\d\s*[편장]|규칙|기준|지침)\s*)?(?<![\d.])(\d{3})\.(?:의\s*(\d+)\s*항)?"
TERM_REF = r"(\d{1,2})\s*편\s*(\d{1,2})\s*장에서 규정하는\s*([가-힣A-Za-z0-9\s]{2,25}?)(?:으로|로|과|와|의|을|를|은|는|이|가|에|\s*[,.)])"
NAMED_REF = r"([가-힣]{3,15}(?:규칙|기준|지침))\s*(\d{1,2})\s*장\s*(\d{3,4})\.(?:의\s*(\d+)\s*항)?"
META_REF = r"^(지침)?\s*(?:(\d{1,2})\s*편\s*)?(\d{1,2})\s*장\s*(\d{3,4})(?:\.의\s*(\d+)\s*항)?\.?$"
DANGLING = r"(?m)(?:일 때|경우|같다|따라)\s*[:：]\s*$"
PRECEDENCE = r"에도 불구하고|불구하고|우선하여 적용|우선 적용|달리 규정|특별히 규정|따로 정하는|적용하지 아니한다|적용하지 않는다"
TERMS = (r"(?:^|\n)\s*\d{1,2}\.\s*([가-힣A-Za-z0-9·\- ]{2,40}?)\s*\(", r"([가-힣A-Za-z0-9·\- ]{2,40}?)(?:\([^)]{1,80}\))?\s*(?:이라|라) 함은", r"[“\"]([^”\"]{2,40})[”\"](?:이란|란|이라 함은|라 함은)")
TERM_STOP = ("규칙", "지침", "우리 선급", "이 규정", "선박", "경우")
WORD_STOP = ("경우", "따라", "따른", "규정", "적합", "이상", "이하", "대하여", "위하여", "한다", "하여야", "있는", "관련")
LOOSE_TERMS = ("최소한", "요건", "기준", "사항", "규정", "값", "경우", "내용", "방법", "절차", "일반")
ATOM = r"(?i)(그림|표|figure|fig\.?|table)\s*\.?\s*([A-Za-z]?\d[\d.\-]*)"
# Kinds of cited targets with how they are written, in order; \\s and \\w are Unicode's.
ARTICLE_TAIL = r"(?:\s*의\s*\d+\s*항)?"
IN_PART = rf"\d+\s*편(?:\s*\d+\s*장)?(?:\s*\d+\s*절)?(?:\s*\d{{3,4}}\.{ARTICLE_TAIL})?"
IN_CHAPTER = rf"\d+\s*장(?:\s*\d+\s*절)?\s*\d{{3,4}}\.{ARTICLE_TAIL}"
CITED = (
    ("external_convention", r"SOLAS[^,。\n]{0,40}"),
    ("external_convention", r"MARPOL[^,。\n]{0,40}"),
    ("external_rule", r"IACS\s*(?:UR|UI|PR|Rec\.?)?[\s\w\.\-]{0,20}"),
    ("internal_appendix", r"부록\s*[\d\-]+(?:\-\d+)?"),
    ("internal_rule", rf"규칙\s*{IN_PART}"),
    ("internal_rule", rf"규칙\s*{IN_CHAPTER}"),
    ("internal_rule", rf"규칙\s*\d{{3,4}}\.{ARTICLE_TAIL}"),
    ("internal_guidance", rf"(?:적용\s*)?지침\s*{IN_PART}"),
    ("internal_guidance", rf"(?:적용\s*)?지침\s*{IN_CHAPTER}"),
    ("internal_guidance", rf"(?:적용\s*)?지침\s*\d{{3,4}}\.{ARTICLE_TAIL}"),
    ("internal_article", rf"(?<![\d.])\d+\s*편\s*\d+\s*장(?:\s*\d+\s*절)?(?:\s*\d{{3,4}}\.{ARTICLE_TAIL})?"),
    ("internal_article", rf"(?<![\d.])\d+\s*장\s*\d{{3,4}}\.{ARTICLE_TAIL}"),
    ("internal_clause", r"\b\d{3,4}\.\s*의\s*\d+\s*항"),
    ("table", r"표\s*\d+(?:\.\d+)+"),
    ("figure", r"그림\s*\d+(?:\.\d+)+"),
)
# The tracks in the order that decides between equally rare ones, and those without a feature.
TRACKS = ("precedence", "def_link", "formula_calc", "figure_qa", "table_lookup", "hierarchy", "crossref")
FALLBACKS = ("spec", "applicability")


def cited(text: Column) -> Column:
    """array of (ref_type, target): what a text cites, each target once, by the first kind that finds it, longest first,
    then by kind and place. A target within another one is left out."""
    trimmed = lambda m: F.regexp_replace(F.regexp_replace(m, r"(?U)\s+", " "), r"^[ ,.]+|[ ,.]+$", "")
    named = lambda kind: lambda m: F.struct(F.lit(kind).alias("ref_type"), trimmed(m).alias("target"))
    found = [F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?U)" + p), F.lit(0)), named(kind)) for kind, p in CITED]
    once = lambda value, then: F.get(F.transform(F.array(value), then), F.lit(0))  # noqa: E731  # a lambda's variable is computed once, a column within a lambda each time
    length = lambda r, i: F.struct((-F.length(r["target"])).alias("shortness"), i.alias("i"), r["ref_type"].alias("ref_type"), r["target"].alias("target"))
    outer = lambda rows: F.filter(rows, lambda r: ~F.exists(rows, lambda o: (o["target"] != r["target"]) & F.contains(o["target"], r["target"])))
    firsts = lambda rows: once(F.transform(rows, lambda o: o["target"]), lambda targets: F.filter(rows, lambda r, i: F.array_position(targets, r["target"]) == i + 1))
    every = F.filter(F.flatten(F.array(*found)), lambda r: r["target"] != "")
    kept = once(F.array_sort(F.transform(every, length)), lambda rows: once(outer(rows), firsts))
    return F.transform(kept, lambda r: F.struct(r["ref_type"].alias("ref_type"), r["target"].alias("target")))


def _blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def part_of(source_file: Column) -> Column:
    """The part that a document's name begins with."""
    return _blank_to_null(F.regexp_extract(source_file, r"^(\d{1,2})편", 1))


def _found(articles: DataFrame, pattern: str, names: list[str], text: str = "content") -> DataFrame:
    """articles with a row for each match, its place, and its groups by name (null where empty)."""
    rows = articles.select("*", F.posexplode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).alias("pos", "said"))
    for i, name in enumerate(names):
        rows = rows.withColumn(name, _blank_to_null(F.regexp_extract("said", pattern, i + 1)))
    return rows


def _only_other(targets: DataFrame, key: list[str]) -> DataFrame:
    """(key..., n, low, high): how many articles share a key, and the first and last of them."""
    return targets.groupBy(*key).agg(F.count("*").alias("n"), F.min("chunk_id").alias("low"), F.max("chunk_id").alias("high"))


def _other(own: Column) -> Column:
    """The one article of a key that isn't one's own; null if there are none or several."""
    return F.when((F.col("n") == 1) & (F.col("low") != own), F.col("low")).when((F.col("n") == 2) & (F.col("low") == own), F.col("high")).when((F.col("n") == 2) & (F.col("high") == own), F.col("low"))


def _checked(found: DataFrame, articles: DataFrame, words: bool = False) -> DataFrame:
    """Mentions (target, item, ...) whose target has the paragraph they name, and not two values that were lost; with
    words, also some word of the line that names it."""
    held = articles.select(F.col("chunk_id").alias("target"), F.left("content", F.lit(6000)).alias("target_text"))
    rows = found.where("target IS NOT NULL").join(held, "target")
    item = F.col("item").isNull() | F.regexp_like("target_text", F.concat(F.lit(r"(?:^|\n)\s*"), F.coalesce("item", F.lit("0")), F.lit(r"\.\s")))
    rows = rows.where(item & (F.regexp_count("target_text", F.lit(DANGLING)) < 2))
    if words:
        nouns = F.filter(F.regexp_extract_all("line", F.lit("[가-힣]{2,7}"), F.lit(0)), lambda w: ~w.isin(*WORD_STOP))
        rows = rows.where((F.size(nouns) == 0) | F.exists(nouns, lambda w: F.contains(F.col("target_text"), w)))
    return rows


def _first(rows: DataFrame, order: list[str], *kept: str) -> DataFrame:
    """The first row of each chunk_id."""
    return rows.groupBy("chunk_id").agg(F.min_by(F.struct(*kept), F.struct(*order)).alias("x")).select("chunk_id", "x.*")


def chapter_mentions(articles: DataFrame) -> DataFrame:
    """Every 'chapter, article' mention, with what stands before it: nothing, the guidance, or a document's name."""
    rows = _found(articles, CHAPTER_REF, ["before", "part", "chapter", "article", "item"])
    name = F.regexp_replace(F.coalesce("before", F.lit("")), r"\s", "")
    return rows.withColumn("kind", F.when(name == "", "plain").when(name == "지침", "guidance").when(name.endswith("지침"), "other_guidance").otherwise("named"))


def chapter_references(articles: DataFrame) -> DataFrame:
    """(chunk_id, target, article, target_type): the first chapter-prefixed reference within a document, to its rules or,
    after 'guidance', to its guidance; one that names a part or a document is another's."""
    said = chapter_mentions(articles).where(F.col("part").isNull() & F.col("kind").isin("plain", "guidance"))
    own = (F.col("kind") == "plain") & (F.col("article") == F.col("article_no")) & (F.col("chapter") == F.col("chapter_no"))
    said = said.where(~F.coalesce(own, F.lit(False))).withColumn("target_type", F.when(F.col("kind") == "guidance", "guidance").otherwise("rule"))
    keys = _only_other(articles, ["source_file", "document_type", "chapter_no", "article_no"]).select("source_file", F.col("document_type").alias("target_type"), F.col("chapter_no").alias("chapter"), F.col("article_no").alias("article"), "n", "low", "high")
    found = said.join(keys, ["source_file", "target_type", "chapter", "article"]).withColumn("target", _other(F.col("chunk_id")))
    return _first(_checked(found, articles), ["pos"], "target", "article", "target_type")


def unique_numbers(said: DataFrame, articles: DataFrame) -> DataFrame:
    """said (chunk_id, source_file, chapter_no, article) with target: the only other article of that number in the
    chapter, or in the document if the chapter has none."""
    rules = articles.where("document_type = 'rule'")
    near = _only_other(rules, ["source_file", "chapter_no", "article_no"]).withColumnRenamed("article_no", "article")
    wide = _only_other(rules, ["source_file", "article_no"]).withColumnRenamed("article_no", "article")
    others = F.col("n") - F.when((F.col("low") == F.col("chunk_id")) | (F.col("high") == F.col("chunk_id")), 1).otherwise(0)
    first = said.join(near, ["source_file", "chapter_no", "article"], "left").withColumn("near", _other(F.col("chunk_id"))).withColumn("n_near", F.coalesce(others, F.lit(0))).drop("n", "low", "high")
    both = first.join(wide, ["source_file", "article"], "left").withColumn("target", F.coalesce("near", F.when(F.col("n_near") == 0, _other(F.col("chunk_id")))))
    return both.drop("n", "low", "high", "near", "n_near")


def bare_references(articles: DataFrame) -> DataFrame:
    """(chunk_id, target, article): the first reference by a bare article number that one article answers, and that has a
    word of the line in which it stands."""
    lines = articles.select("chunk_id", "source_file", "chapter_no", "article_no", F.posexplode(F.split("content", "\n")).alias("line_no", "line"))
    said = _found(lines, BARE_REF, ["before", "article", "item"], "line").where(F.col("before").isNull() & ~F.col("article").eqNullSafe(F.col("article_no")))
    return _first(_checked(unique_numbers(said, articles), articles, words=True), ["line_no", "pos"], "target", "article")


def precedence(articles: DataFrame) -> DataFrame:
    """(chunk_id, marker, sentence, counterpart): the line that says what goes before what, and the article of the same
    document that it names, if there is one."""
    marked = articles.withColumn("marker", F.regexp_extract("content", PRECEDENCE, 0)).where("marker <> ''")
    line = F.get(F.filter(F.split("content", "\n"), lambda x: F.contains(x, F.col("marker"))), F.lit(0))
    marked = marked.select("chunk_id", "source_file", "chapter_no", "marker", F.left(F.trim(line), F.lit(300)).alias("sentence"))
    named = _found(marked, r"(?<![\d.])(\d{3})\.(?:의\s*(\d+)\s*항)?", ["article", "item"], "sentence")
    found = unique_numbers(named, articles).where("target IS NOT NULL")
    return marked.select("chunk_id", "marker", "sentence").join(_first(found, ["pos"], "target").withColumnRenamed("target", "counterpart"), "chunk_id", "left")


def defined_terms(articles: DataFrame) -> DataFrame:
    """(source_file, term, definition): the first article of definitions of a document that explains a term."""
    explains = articles.where((F.col("document_type") == "rule") & F.col("article_title").rlike("정의|용어"))
    every = F.flatten(F.array(*[F.regexp_extract_all("content", F.lit(p), F.lit(1)) for p in TERMS]))
    terms = explains.select("source_file", "chunk_id", F.explode(every).alias("said")).withColumn("term", F.regexp_replace(F.trim("said"), r"^\d{1,2}[.)]?\s+", ""))
    return terms.where((F.length("term") >= 2) & ~F.col("term").isin(*TERM_STOP)).groupBy("source_file", "term").agg(F.min("chunk_id").alias("definition"))


def definition_links(articles: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(chunk_id, term, definition): the longest term, defined elsewhere in the same document, that an article uses."""
    terms = defined_terms(articles) if terms is None else terms
    used = articles.select("chunk_id", "source_file", "content").join(terms, "source_file").where((F.col("definition") != F.col("chunk_id")) & F.contains("content", "term"))
    return used.groupBy("chunk_id").agg(F.min_by(F.struct("term", "definition"), F.struct(-F.length("term"), F.col("term"))).alias("x")).select("chunk_id", "x.*")


def cross_document_references(articles: DataFrame) -> DataFrame:
    """(chunk_id, target, form): the first reference to another part: by part, chapter and article; by a term that one
    title, or one text more often than others, holds; or by a structured reference."""
    keyed = articles.withColumn("own_part", part_of(F.col("source_file"))).where("own_part IS NOT NULL")
    keys = _only_other(keyed, ["own_part", "document_type", "chapter_no", "article_no"]).select(F.col("own_part").alias("part"), F.col("document_type").alias("target_type"), F.col("chapter_no").alias("chapter"), F.col("article_no").alias("article"), "n", "low", "high")

    def by_number(said: DataFrame) -> DataFrame:
        found = said.join(keys, ["part", "target_type", "chapter", "article"]).withColumn("target", _other(F.col("chunk_id")))
        return _checked(found, articles).select("chunk_id", "form", "pos", "target")

    numbers = chapter_mentions(articles).where(F.col("part").isNotNull() & (F.col("kind") != "other_guidance"))
    numbers = numbers.withColumn("target_type", F.when(F.col("kind") == "guidance", "guidance").otherwise("rule")).withColumn("form", F.lit("1 number"))
    out = by_number(numbers)
    said = _found(articles, TERM_REF, ["part", "chapter", "raw"]).withColumn("term", F.trim("raw"))
    own = (F.col("part") == part_of(F.col("source_file"))) & (F.col("chapter") == F.col("chapter_no"))
    said = said.where(~F.coalesce(own, F.lit(False)) & (F.length("term") >= 2) & ~F.col("term").isin(*LOOSE_TERMS)).select("chunk_id", "pos", "part", "chapter", "term")
    pool = keyed.where("document_type = 'rule'").select(F.col("own_part").alias("part"), F.col("chapter_no").alias("chapter"), F.col("chunk_id").alias("target"), "article_title", F.col("content").alias("target_text"))
    # A term is looked for once in each text and title of its chapter, however many references ask for it and however many
    # articles say the same. How often it stands in a text: what its removal takes off, by its length.
    asked = said.select("part", "chapter", "term").distinct()
    alike = lambda c: pool.groupBy("part", "chapter", c).agg(F.count("*").alias("n"), F.min("target").alias("low")).join(asked, ["part", "chapter"])
    times = ((F.length("target_text") - F.length(F.replace(F.col("target_text"), F.col("term"), F.lit("")))) / F.length("term")).cast("int")
    titles = alike("article_title").where(F.contains("article_title", "term")).groupBy("part", "chapter", "term").agg(F.sum("n").alias("n_titled"), F.min("low").alias("by_title"))
    ranked = alike("target_text").withColumn("times", times).where("times > 0").groupBy("part", "chapter", "term", "times").agg(F.sum("n").alias("alike"), F.min("low").alias("by_text"))
    most = ranked.groupBy("part", "chapter", "term").agg(F.max_by(F.struct("alike", "by_text"), "times").alias("m"))
    found = titles.join(most, ["part", "chapter", "term"], "full_outer").withColumn("target", F.when(F.col("n_titled") == 1, F.col("by_title")).when(F.col("n_titled").isNull() & (F.col("m.alike") == 1), F.col("m.by_text")))
    chosen = said.join(found.where("target IS NOT NULL").select("part", "chapter", "term", "target"), ["part", "chapter", "term"])
    terms = chosen.where("target <> chunk_id").withColumn("item", F.lit(None).cast("string")).withColumn("form", F.lit("2 term"))
    out = out.unionByName(_checked(terms, articles).select("chunk_id", "form", "pos", "target"))
    if "references" in articles.columns:
        listed = articles.select("chunk_id", F.posexplode("references").alias("pos", "r")).where(F.col("r.ref_type").isin("internal_article", "internal_rule", "internal_guidance"))
        parsed = listed.select("chunk_id", "pos", *[_blank_to_null(F.regexp_extract(F.trim("r.target"), META_REF, i)).alias(n) for i, n in enumerate(("guide", "part", "chapter", "article", "item"), 1)], F.col("r.ref_type").alias("ref_type"))
        parsed = parsed.where("part IS NOT NULL").withColumn("target_type", F.when(F.col("guide").isNotNull() | (F.col("ref_type") == "internal_guidance"), "guidance").otherwise("rule")).withColumn("form", F.lit("3 structured"))
        out = out.unionByName(by_number(parsed))
    return _first(out, ["form", "pos"], "target", "form")


def named_document_references(articles: DataFrame) -> DataFrame:
    """(chunk_id, target, name): the first reference to a document by name, where the name stands in one document's name
    only. Names are short, so documents are listed by the pieces of theirs that a reference can have: equal keys only."""
    said = _found(articles, NAMED_REF, ["raw", "chapter", "article", "item"]).withColumn("name", F.regexp_replace("raw", r"\s", ""))
    documents = articles.select("source_file").distinct().withColumn("flat", F.regexp_replace("source_file", r"[\s_]", ""))
    lengths = F.sequence(F.lit(5), F.least(F.lit(17), F.length("flat")))
    pieces = F.flatten(F.transform(lengths, lambda n: F.transform(F.sequence(F.lit(1), F.length("flat") - n + 1), lambda i: F.substr("flat", i, n))))
    listed = documents.where(F.length("flat") >= 5).select("source_file", F.explode(F.array_distinct(pieces)).alias("name"))
    one = listed.groupBy("name").agg(F.count("*").alias("documents"), F.min("source_file").alias("document")).where("documents = 1").select("name", "document")
    keys = _only_other(articles.where("document_type = 'rule'"), ["source_file", "chapter_no", "article_no"]).select(F.col("source_file").alias("document"), F.col("chapter_no").alias("chapter"), F.col("article_no").alias("article"), "n", "low", "high")
    found = said.join(one, "name").join(keys, ["document", "chapter", "article"]).withColumn("target", _other(F.col("chunk_id")))
    return _first(_checked(found, articles), ["pos"], "target", "name")


def mirror_links(articles: DataFrame) -> DataFrame:
    """(rule, guidance): the first rule and the first guidance of one chapter, section and article of a document."""
    first = articles.groupBy("source_file", "chapter_no", "section_no", "article_no").agg(F.min(F.when(F.col("document_type") == "rule", F.col("chunk_id"))).alias("rule"), F.min(F.when(F.col("document_type") == "guidance", F.col("chunk_id"))).alias("guidance"))
    return first.where("rule IS NOT NULL AND guidance IS NOT NULL").select("rule", "guidance")


def atom_key(text: Column, anywhere: bool) -> Column:
    """struct(kind, number) of a table's or figure's name, at the beginning or anywhere."""
    pattern = ATOM if anywhere else ATOM.replace("(?i)", r"(?i)^\s*")
    kind = F.rtrim(F.lower(F.regexp_extract(text, pattern, 1)), F.lit("."))
    return F.struct(F.when(kind.isin("그림", "figure", "fig"), "figure").when(kind.isin("표", "table"), "table").alias("kind"), F.rtrim(F.regexp_extract(text, pattern, 2), F.lit(".")).alias("number"))


def citation_links(chunks: DataFrame) -> DataFrame:
    """(chunk_id, linked_figure_chunk_ids, linked_table_chunk_ids) of chunks (doc_id, document_type, chunk_id, chunk_order,
    chunk_type, caption, references): the first figure or table of each cited name, in order, once each."""
    atoms = chunks.where(F.col("chunk_type").isin("figure", "table")).select("doc_id", "document_type", "chunk_id", "chunk_order", atom_key(F.col("caption"), True).alias("k")).where("k.kind = chunk_type OR k.kind IS NOT NULL")
    first = atoms.groupBy("doc_id", "document_type", "k").agg(F.min_by("chunk_id", "chunk_order").alias("atom"))
    cited = chunks.where(F.col("chunk_type").isin("text", "article")).select("doc_id", "document_type", "chunk_id", F.posexplode("references").alias("pos", "r"))
    met = cited.select("doc_id", "document_type", "chunk_id", "pos", atom_key(F.col("r.target"), False).alias("k")).where("k.kind IS NOT NULL").join(first, ["doc_id", "document_type", "k"])
    listed = lambda kind: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("k.kind") == kind, F.struct("pos", "atom")))), lambda x: x["atom"]))
    return met.groupBy("chunk_id").agg(listed("figure").alias("linked_figure_chunk_ids"), listed("table").alias("linked_table_chunk_ids"))


def promote_tables(chunks: DataFrame) -> DataFrame:
    """chunks with chunk_level parent for the tables that have rows of their own."""
    owners = chunks.where("chunk_type = 'table_row'").select(F.col("parent_chunk_id").alias("owner")).distinct()
    joined = chunks.join(owners, F.col("chunk_id") == F.col("owner"), "left")
    return joined.withColumn("chunk_level", F.when(F.col("owner").isNotNull() & (F.col("chunk_type") == "table"), "parent").otherwise(F.col("chunk_level"))).drop("owner")


def attach_blocks(parents: DataFrame, blocks: DataFrame, links: str, heading: str, most_chars: int, marker: str) -> DataFrame:
    """parents with the texts of the blocks (chunk_id, block) that they link, in order and once each, up to a budget; what
    would pass it, and all after it, gives way to a marker."""
    linked = parents.select("chunk_id", F.posexplode(F.array_distinct(links)).alias("pos", "b")).join(blocks.select(F.col("chunk_id").alias("b"), "block").where("block <> ''"), "b")
    texts = capped_concat(linked, "chunk_id", "pos", "block", most_chars, marker, "\n\n").select("chunk_id", "context")
    joined = parents.join(texts, "chunk_id", "left")
    return joined.withColumn("content", F.when(F.col("context").isNotNull(), F.concat(F.rtrim("content"), F.lit(f"\n\n[{heading}]\n"), F.col("context"))).otherwise(F.col("content"))).drop("context")


def route_tracks(features: DataFrame, most_same_term: int = 2) -> DataFrame:
    """(chunk_id, source_file, track) for features (chunk_id, source_file, term, and a boolean for each of TRACKS): the
    rarest feature that an article has; a term's definition serves a document twice at most, then the next feature
    counts; without any, one of FALLBACKS by the parity of a hash."""
    counts = features.agg(*[F.count_if(t).alias(t) for t in TRACKS]).first()  # seven numbers
    order = sorted(TRACKS, key=lambda t: (counts[t], TRACKS.index(t)))
    pick = lambda names: F.coalesce(*[F.when(F.col(t), t) for t in names])
    rows = features.withColumn("track", pick(order)).withColumn("next", pick([t for t in order if t != "def_link"]))
    turn = F.row_number().over(Window.partitionBy("source_file", "term", "track").orderBy("chunk_id"))
    rows = rows.withColumn("turn", turn).withColumn("track", F.when((F.col("track") == "def_link") & (F.col("turn") > most_same_term), F.col("next")).otherwise(F.col("track")))
    odd = F.conv(F.substring(F.sha2(F.concat("source_file", F.lit("|"), "chunk_id"), 256), 64, 1), 16, 10).cast("int") % 2
    return rows.select("chunk_id", "source_file", F.coalesce("track", F.when(odd == 0, FALLBACKS[0]).otherwise(FALLBACKS[1])).alias("track"))
