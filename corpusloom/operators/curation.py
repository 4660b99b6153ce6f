"""Normalising, deduplicating, masking and gating of text records (columns doc_id or id, text, lang, ...)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import content_hash, normalize_text
from corpusloom.operators import near_dup

# Patterns of personal numbers, in order of precedence, with the tag that replaces them.
PERSONAL = (
    ("KR_RRN", r"(?U)\b\d{6}[-\s]?[1-8]\d{6}\b"),
    ("KR_PHONE", r"(?U)\b01[016789][-\s.]?\d{3,4}[-\s.]?\d{4}\b"),
    ("KR_PHONE", r"(?U)\b0\d{1,2}[-\s.]?\d{3,4}[-\s.]?\d{4}\b"),
    ("EMAIL_ADDRESS", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("KR_BANK_ACCOUNT", r"(?U)\b\d{2,6}-\d{2,6}-\d{2,6}(?:-\d{1,6})?\b"),
)
# Turns of phrase of prompt injection.
INJECTION = (
    r"ignore (all |the |your )?(previous|above|prior) (instructions|prompts?)",
    r"disregard (all |the )?(previous|above|prior)",
    r"forget (all |the |your )?(previous|above|prior|earlier)",
    r"system prompt",
    r"reveal (your |the )?(system )?(prompt|instructions)",
    r"developer mode",
    r"\bDAN\b",
    r"jailbreak",
    r"이전\s*(지시|명령|프롬프트)\s*(무시|잊)",
    r"시스템\s*프롬프트",
    r"규칙\s*무시",
)


@dataclass(frozen=True)
class GateRules:
    """Limits of the quality gate."""

    least_chars: int = 10
    most_chars: int = 20_000
    languages: tuple[str, ...] = ("ko", "en")
    most_duplicates: float = 0.2
    most_near_duplicates: float | None = None
    near_threshold: float = 0.85
    required_metadata: tuple[str, ...] = field(default=())


def normalize_records(records: DataFrame, text: str = "text") -> DataFrame:
    return records.withColumn(text, normalize_text(F.col(text)))


def first_by(records: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order; rows of one key meet in one window, sorted, never collected."""
    names = [f"_key{i}" for i in range(len(keys))]
    keyed = records.select("*", *[k.alias(n) for k, n in zip(keys, names, strict=True)])
    return keyed.withColumn("_rank", F.row_number().over(Window.partitionBy(*names).orderBy(*order))).where("_rank = 1").drop("_rank", *names)


def exact_dedup(records: DataFrame, order: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One record of each normalised text: the first by `order`, records without an order last; `keep` names the
    columns that are wanted of it. Null texts count as one.

    Firsts are found in one aggregation, before the shuffle where copies lie in one task, so a text by the
    thousand sends one row from each task and no group is gathered.
    """
    kept = F.struct(*[F.col(c) for c in keep or records.columns])
    first = F.min_by(kept, F.struct(F.col(order).isNull().alias("late"), F.col(order).alias("at")))
    return records.groupBy(content_hash(F.col(text)).alias("content_hash of exact_dedup")).agg(first.alias("first of exact_dedup")).select("`first of exact_dedup`.*")


def duplicate_ratio(text: Column) -> Column:
    n, distinct = F.count(text), F.count_distinct(content_hash(text))
    return F.round(F.when(n == 0, 0.0).otherwise((n - distinct) / n), 4)


def filter_languages(records: DataFrame, allowed: list[str], lang: str = "lang") -> DataFrame:
    """Records of an allowed or unknown language."""
    return records.where(F.col(lang).isNull() | F.col(lang).isin(*allowed))


def mask_personal(text: Column, patterns=PERSONAL) -> Column:
    """Each pattern's matches by <TAG>, in the order of precedence."""
    for tag, pattern in patterns:
        text = F.regexp_replace(text, pattern, f"<{tag}>")
    return text


def personal_counts(text: Column, patterns=PERSONAL) -> dict[str, Column]:
    """Matches of each tag, as masking in order of precedence would find them."""
    counts: dict[str, Column] = {}
    for tag, pattern in patterns:
        n = F.regexp_count(text, F.lit(pattern))
        counts[tag] = counts[tag] + n if tag in counts else n
        text = F.regexp_replace(text, pattern, f"<{tag}>")
    return counts


def injection_hits(text: Column, patterns=INJECTION) -> Column:
    """Indices of the injection patterns found, in any case."""
    return F.array_compact(F.array(*[F.when(text.rlike(f"(?i){p}"), F.lit(i)) for i, p in enumerate(patterns)]))


def banned_pattern(term: str) -> str | None:
    """A term as a whole word of any script, in any case, blanks between its characters allowed; None if blank."""
    chars = [f"\\{c}" if not c.isalnum() and c.isascii() else c for c in term if not c.isspace()]
    return r"(?iU)(?<!\w)" + r"\s*".join(chars) + r"(?!\w)" if chars else None


def banned_hits(text: Column, terms: list[str]) -> Column:
    found = [(t.strip(), p) for t in terms if (p := banned_pattern(t))]
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(t)) for t, p in found])) if found else F.array().cast("array<string>")


def quality_report(records: DataFrame, rules: GateRules = GateRules(), text: str = "text", lang: str = "lang", id_column: str = "doc_id") -> DataFrame:
    """One row: counters of the gate in one pass, the share of near copies where the rules bound it, and whether it
    passes. An empty input fails."""
    t = F.length(F.col(text))
    counts = records.agg(
        F.count("*").alias("n"), F.count_if(t < rules.least_chars).alias("too_short"), F.count_if(t > rules.most_chars).alias("too_long"),
        F.count_if(F.col(lang).isNotNull() & ~F.col(lang).isin(*rules.languages)).alias("bad_lang"), duplicate_ratio(F.col(text)).alias("dup_ratio"),
        *[F.count_if(F.try_element_at("metadata", F.lit(k)).isNull()).alias(f"missing_{k}") for k in rules.required_metadata],
    )
    missing = sum((F.col(f"missing_{k}") for k in rules.required_metadata), F.lit(0))
    ok = (F.col("n") > 0) & (F.col("too_short") == 0) & (F.col("too_long") == 0) & (F.col("bad_lang") == 0) & (F.col("dup_ratio") <= rules.most_duplicates) & (missing == 0)
    if rules.most_near_duplicates is None:
        return counts.withColumn("passed", ok)
    kept = near_dup.keep_first(records.select(id_column, text), rules.near_threshold, id_column=id_column, text=text)
    share = counts.crossJoin(F.broadcast(kept.agg(F.count("*").alias("n_kept"))))  # one row each
    ratio = F.round(F.when(F.col("n") == 0, 0.0).otherwise((F.col("n") - F.col("n_kept")) / F.col("n")), 4)
    return share.withColumn("near_dup_ratio", ratio).withColumn("passed", ok & (F.col("near_dup_ratio") <= rules.most_near_duplicates)).drop("n_kept")


def expectation_report(records: DataFrame, id_column: str = "doc_id", text: str = "text", least: int = 10, most: int = 20_000) -> DataFrame:
    """Not-null text, length within bounds, unique id: unexpected rows of each expectation."""
    n = F.length(text)
    return records.agg(F.count_if(F.col(text).isNull()).alias("null_text"), F.count_if(~n.between(least, most)).alias("bad_length"), (F.count(id_column) - F.count_distinct(id_column)).alias("repeated_ids"))


def repeated_lines(records: DataFrame, least: int = 3, most_chars: int = 15, text: str = "text") -> DataFrame:
    """Lines of fewer than most_chars characters that stand in `least` places or more: running heads and the like."""
    lines = records.select(F.explode(F.split(F.col(text), "\n")).alias("line")).select(F.trim("line").alias("line"))
    return lines.where((F.length("line") > 0) & (F.length("line") < most_chars)).groupBy("line").agg(F.count("*").alias("n")).where(F.col("n") >= least)


# How a diagram that a caption makes up begins.
DIAGRAM = r"```\s*mermaid|graph\s+(TD|LR|RL|BT)\b|flowchart\s+(TD|LR)"


def degenerate_caption(text: Column, n: int = 8, share: float = 0.3, least: int = 24) -> Column:
    """Whether one n-gram of words covers more than `share` of a caption of `least` words or more. The last n-gram
    isn't counted."""
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")
    size = F.size(words)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(size - n, F.lit(1))), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))
    run = F.aggregate(F.sort_array(grams), F.struct(F.lit("").alias("last"), F.lit(0).alias("now"), F.lit(0).alias("most")), lambda a, g: F.struct(g.alias("last"), F.when(a["last"] == g, a["now"] + 1).otherwise(1).alias("now"), F.greatest(a["most"], F.when(a["last"] == g, a["now"] + 1).otherwise(1)).alias("most")))["most"]
    return F.coalesce((size >= least) & (run * n / size > share), F.lit(False))


def confabulated_caption(text: Column) -> Column:
    """Whether a caption is a made-up diagram: it begins one, or has two arrows or more."""
    return F.coalesce(text.rlike(DIAGRAM) | (F.regexp_count(text, F.lit("-->")) >= 2), F.lit(False))
