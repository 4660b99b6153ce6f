"""Repairs of parsed layouts: fragments of figures, atoms among texts, spaces within formulas; values read from training logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.structure import islands

# How a numbered figure or table is named, a formula is fenced, and a log line gives a value.
NUMBERED = r"(?i)(그림|표|figure|fig\.?|table)\s*\.?\s*[A-Za-z]?\d"
FORMULA = r"(?s)\$\$.*?\$\$|\$[^$\n]+\$"
TEXT_GROUP = r"\\text\s*\{[^{}]*\}"
LOSS = r"'loss':\s*'?([+-]?[0-9][0-9.]*(?:[eE][+-]?[0-9]+)?)"
EPOCH = r"'epoch':\s*'?([+-]?[0-9][0-9.]*(?:[eE][+-]?[0-9]+)?)"
ENTRY = r"'(\w+)':\s*'?([^,'}]+)"


def merge_figure_fragments(figures: DataFrame) -> DataFrame:
    """Figures (doc_id, seq, page, anchor, captions array, footnotes array, img_path, content, sub_type) with the pieces of one
    figure made one: consecutive pieces of a page and anchor of which the captions name exactly one number. A merged
    figure has the place of its first piece, the path of its numbered one, each caption once, and img_paths; others
    are left as they are, with null img_paths. Other columns are left out. Null captions count as none; seq is one row's
    in its document."""
    rows = islands(figures, ["doc_id"], "seq", ["page", "anchor"]).withColumn("numbers", F.regexp_count(F.concat_ws(" ", "captions"), F.lit(NUMBERED)))
    run = Window.partitionBy("doc_id", "island")
    joins = (F.count("*").over(run) > 1) & (F.sum("numbers").over(run) == 1)
    rows = rows.withColumn("joins", joins).withColumn("place", F.when(F.col("joins"), F.min("seq").over(run)).otherwise(F.col("seq")))
    piece = F.struct("seq", "captions", "footnotes", "img_path", "content", "sub_type", "numbers")
    merged = rows.groupBy("doc_id", "place").agg(F.array_sort(F.collect_list(piece)).alias("p"), F.first("page").alias("page"), F.first("anchor").alias("anchor"), F.first("joins").alias("joins"))
    filled = lambda texts: F.filter(F.transform(texts, lambda t: F.trim(t)), lambda t: F.length(t) > 0)
    every = lambda name: F.flatten(F.filter(F.transform("p", lambda x: x[name]), lambda a: a.isNotNull()))
    one = F.col("p")[0]
    chosen = lambda whole, own: F.when(F.col("joins"), whole).otherwise(own)
    paths = F.filter(F.transform("p", lambda x: x["img_path"]), lambda t: F.length(t) > 0)
    return merged.select(
        "doc_id",
        F.col("place").alias("seq"),
        "page",
        "anchor",
        chosen(F.array(F.array_join(F.array_distinct(filled(every("captions"))), " ")), one["captions"]).alias("captions"),
        chosen(every("footnotes"), one["footnotes"]).alias("footnotes"),
        chosen(F.filter("p", lambda x: x["numbers"] > 0)[0]["img_path"], one["img_path"]).alias("img_path"),
        F.when(F.col("joins"), paths).alias("img_paths"),
        chosen(F.array_join(filled(F.transform("p", lambda x: x["content"])), "\n"), one["content"]).alias("content"),
        chosen(F.get(F.filter(F.transform("p", lambda x: x["sub_type"]), lambda t: F.length(t) > 0), F.lit(0)), one["sub_type"]).alias("sub_type"),
        F.size("p").alias("n_parts"),
    )


def interleave(texts: DataFrame, atoms: DataFrame) -> DataFrame:
    """(doc_id, ord, kind, pos, seq, content) of texts and atoms (doc_id, pos, seq, content) in the order of the source: an atom at
    a position stands before the text that begins there. ord counts from 0 in each document."""
    names = ["doc_id", "pos", "seq", "content"]
    both = atoms.select(F.lit("atom").alias("kind"), *names).unionByName(texts.select(F.lit("text").alias("kind"), *names))
    along = Window.partitionBy("doc_id").orderBy("pos", "kind", "seq")
    return both.select("doc_id", (F.row_number().over(along) - 1).cast("long").alias("ord"), "kind", "pos", "seq", "content")


def _between(text: Column, pattern: str, change, keep) -> Column:
    """text with `change` applied to what matches the pattern and `keep`, by place and number of places, to the rest."""
    found, rest = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    last = F.size(rest) - 1
    parts = F.transform(rest, lambda t, i: F.concat(keep(t, i, last), F.when(i < last, change(F.get(found, i))).otherwise("")))
    return F.array_join(parts, "")


def join_letters(text: Column) -> Column:
    """Single characters in a row without the spaces between them: 'a s - b u i l t' is 'as-built'. Other runs of spaces become one."""
    joined = F.regexp_replace(text, r"(?<=^\S|[ ]\S)[ ](?=\S(?:[ ]|$))", "")
    return F.regexp_replace(F.regexp_replace(joined, "^ +| +$", ""), " +", " ")


def tighten(formula: Column) -> Column:
    """A formula without spaces, but for those after a command before a letter and those between Hangul words."""
    marked = F.regexp_replace(join_letters(formula), r"(\\[a-zA-Z]+)\s+(?=[a-zA-Z])", "$1\u0001")
    marked = F.regexp_replace(marked, r"(?<=[가-힣])\s+(?=[가-힣])", "\u0001")
    return F.translate(F.regexp_replace(marked, r"\s+", ""), "\u0001", " ")


def tidy_math(text: Column) -> Column:
    """A text whose fenced formulas, $..$ and $$..$$, have lost the spaces that a recogniser put between their letters;
    within \\text{..} only single letters are joined. Null stays null, and what is not fenced stays as it is."""
    edge = "\u0002"  # stands where a \text{..} was cut out, so that what touched it is not taken for a single letter

    def words(group: Column) -> Column:
        inner = F.regexp_extract(group, r"\{([^{}]*)\}", 1)
        return F.concat(F.lit("\\text{"), join_letters(inner), F.lit("}"))

    def outside(part: Column, i: Column, last: Column) -> Column:
        cut = F.concat(F.when(i > 0, edge).otherwise(""), part, F.when(i < last, edge).otherwise(""))
        return F.translate(tighten(cut), edge, "")

    def formula(span: Column) -> Column:
        display = span.startswith("$$")
        inner = F.regexp_replace(span, r"^\$\$?|\$\$?$", "")
        tidy = _between(inner, TEXT_GROUP, words, outside)
        return F.when(display, F.concat(F.lit("$$ "), tidy, F.lit(" $$"))).otherwise(F.concat(F.lit("$"), tidy, F.lit("$")))

    return _between(text, FORMULA, formula, lambda t, i, last: t)


def loss_curve(lines: DataFrame) -> DataFrame:
    """(run_id, step, loss, epoch) of the log lines (run_id, ord, line) that give a loss; steps count from 1 in each run. A line
    without a number for its loss gives no row, one without an epoch a null."""
    line = F.trim("line")
    found = lines.where(line.startswith("{") & line.rlike(LOSS)).select("run_id", "ord", "line")
    number = lambda pattern: F.regexp_extract("line", pattern, 1).try_cast("double")
    rows = found.select("run_id", "ord", F.round(number(LOSS), 4).alias("loss"), number(EPOCH).alias("epoch")).where("loss IS NOT NULL")
    step = F.row_number().over(Window.partitionBy("run_id").orderBy("ord"))
    return rows.select("run_id", step.cast("long").alias("step"), "loss", "epoch")


def train_stats(lines: DataFrame) -> DataFrame:
    """(run_id, key, value) of the log lines (run_id, ord, line) that tell trained parameters or the adapter's change; the last value of a key counts."""
    line = F.trim("line")
    told = lines.where(line.startswith("{") & line.rlike("trainable_params|adapter_delta_norm"))
    entries = told.select("run_id", "ord", F.posexplode(F.regexp_extract_all("line", F.lit(ENTRY), F.lit(0))).alias("pos", "entry"))
    pairs = entries.select("run_id", F.struct("ord", "pos").alias("at"), F.regexp_extract("entry", ENTRY, 1).alias("key"), F.trim(F.regexp_extract("entry", ENTRY, 2)).alias("value"))
    return pairs.groupBy("run_id", "key").agg(F.max_by("value", "at").alias("value"))
