"""Checks of answers against their evidence: quotes, numbers, symbols, swapped terms, conclusions."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from corpusloom.functions.text import SPACES

SYMBOL = r"(?<![A-Za-z0-9])[A-Z](?:_?\{?[a-z0-9]{1,2}\}?)(?![a-z0-9])"
# Symbols that are units, elements and abbreviations.
KNOWN_SYMBOLS = ("Hz", "Pa", "Nm", "Nmm", "No", "Cu", "Ni", "Cr", "Al", "Mg", "Ti", "Zn", "Fe", "Mn", "Si", "Mo", "Co", "Pb", "Sn")
# Standards without a number, conclusions for and against, and talk about the making of an answer.
PLACEHOLDER = r"(?i)\b(?:ISO|IEC|KS|JIS|ASME|EN|API)[\s\-–—:]*0{3,5}(?!\d)"
# Endings of inflected words, a number that is no reference or year, the ends of sentences, and how much of a line is shown.
INFLECTED = "(?:다|며|고|서|여|록|면|니|지)$"
CLAIM = r"(?<!\d)(?<!\d[.,])\d[\d,]*+(?:\.\d++)?+\s*+%?+(?!\s*(?:\.|항|장|절|편|호|조|년|번))"
SENTENCES, LINES, LINE_CHARS = r"(?<=다)\.\s+", r"(?<=다)\.\s+|\n", 200
APPLIES = r"적용된다|적용 대상이다|적용 대상이며|적용되며|적용받는다|적용되지만|적용되고"
APPLIES_NOT = r"적용되지 않|적용 대상이 아니|적용하지 않|미적용"
DENIED_DENIAL = r"(?:미적용|적용되지 않는 것|적용 배제)(?:이|의)?(?:\s*사유)?(?:가|이|은|는)?\s*아니"
META_TALK = r"label|라벨|시나리오를 만들|출제|수정한다|설정하고|이어야 한다\. 수정"


def bare(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, "")


def quote_in(quote: Column, text: Column, prefix: int = 40, window: int = 15, step: int = 5) -> Column:
    """Whether a quote stands in a text, white space aside: whole, by its first `prefix` characters, or in pieces (cut
    at ellipses and sentence ends, eight characters or more) of which half have a run of `window` in common."""
    q, t = bare(quote), bare(text)
    pieces = F.filter(F.split(q, r"\.{3}|…|(?<=다\.)"), lambda p: F.length(p) >= 8)
    starts = lambda p: F.sequence(F.lit(0), F.greatest(F.length(p) - window, F.lit(0)), F.lit(step))
    hit = F.filter(pieces, lambda p: F.exists(starts(p), lambda i: F.contains(t, F.substr(p, i + 1, F.lit(window)))))
    parts = (F.size(pieces) >= 2) & (F.size(hit) >= 1) & (F.size(hit) / F.size(pieces) >= 0.5)
    return (q != "") & (F.contains(t, q) | ((F.length(q) >= prefix) & F.contains(t, F.left(q, F.lit(prefix)))) | parts)


@F.pandas_udf(DoubleType())
def _ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, a, b).ratio() if a is not None and b is not None else None for a, b in zip(left, right, strict=True)], dtype="float64")


def edit_similarity(left: Column, right: Column) -> Column:
    """0 where one is empty; the ratio of lengths where one holds the other; else the share of matching blocks. Only
    texts that are neither leave the JVM's expressions."""
    a, b = F.coalesce(left, F.lit("")), F.coalesce(right, F.lit(""))
    held = F.contains(a, b) | F.contains(b, a)
    near = F.when((a != "") & (b != "") & ~held, a)
    lengths = F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b))
    return F.when((a == "") | (b == ""), 0.0).when(held, lengths).otherwise(_ratio(near, b))


def claimed_numbers(text: Column) -> Column:
    """The numbers of two characters or more, thousands separators and blanks removed."""
    found = F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\d[\d,]*(?:\.\d+)?\s*%?"), F.lit(0)), lambda n: F.length(F.regexp_replace(n, r"\s+$", "")) >= 2)
    return F.array_distinct(F.transform(found, lambda n: F.regexp_replace(F.regexp_replace(n, r"[,\s]", ""), r"\.$", "")))


def ungrounded_numbers(answer: Column, *grounds: Column, most: int = 5) -> Column:
    """Numbers of an answer that stand in none of its grounds, the first few in order."""
    held = F.flatten(F.array(*[claimed_numbers(g) for g in grounds]))
    return F.slice(F.array_sort(F.array_except(claimed_numbers(answer), held)), 1, most)


def plain_symbols(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[${}_]", "")


def foreign_symbols(said: Column, evidence: Column) -> Column:
    """Symbols (a capital with one or two small letters or digits) that the evidence doesn't show."""
    found = F.array_distinct(F.regexp_extract_all(plain_symbols(said), F.lit(SYMBOL), F.lit(0)))
    return F.array_sort(F.filter(found, lambda s: (F.length(s) >= 2) & ~s.isin(*KNOWN_SYMBOLS) & ~F.contains(plain_symbols(evidence), s)))


def one_sided_pairs(words: Column, said: Column, alike, most: int) -> Column:
    """Pairs (a, b) of sorted words that are alike, of which a text names exactly one: terms that may be swapped."""
    sorted_ = F.array_sort(F.array_distinct(words))
    pairs = F.flatten(F.transform(sorted_, lambda a, i: F.transform(F.filter(F.slice(sorted_, i + 2, F.greatest(F.size(sorted_) - i - 1, F.lit(0))), lambda b: alike(a, b) & (F.contains(said, a) != F.contains(said, b))), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return F.slice(pairs, 1, most)


def symbol_pairs(article: Column, said: Column, most: int = 4) -> Column:
    """Symbols of one capital of which a text names one and not the other."""
    found = F.regexp_extract_all(plain_symbols(article), F.lit(SYMBOL), F.lit(0))
    return one_sided_pairs(found, plain_symbols(said), lambda a, b: F.left(a, F.lit(1)) == F.left(b, F.lit(1)), most)


def side_pairs(article: Column, said: Column, most: int = 2) -> Column:
    """Terms that end in 'side' of which a text names one and not the other."""
    return one_sided_pairs(F.regexp_extract_all(article, F.lit("[가-힣]{1,4}측"), F.lit(0)), said, lambda a, b: F.lit(True), most)


def confusable_pairs(article: Column, said: Column, pattern: str = "[가-힣]{2,7}", most: int = 4) -> Column:
    """Words with the same first letter, of lengths that differ by two at most, none within the other, of which a text
    names one and not the other."""
    alike = lambda a, b: (F.left(a, F.lit(1)) == F.left(b, F.lit(1))) & (F.abs(F.length(a) - F.length(b)) <= 2) & ~F.contains(a, b) & ~F.contains(b, a)
    return one_sided_pairs(F.regexp_extract_all(article, F.lit(pattern), F.lit(0)), said, alike, most)


def numeric_term_mismatches(question: Column, answer: Column, article: Column) -> Column:
    """array of (used, expected, value, article_line): numbers of two characters or more that an answer claims in a
    sentence with one term of a pair, while the article's lines with that number have the other term only.

    Pairs are words that may be confused (inflected ones aside), symbols and sides, of which question and answer name
    one. References and years ("203.", "5항") are no claims, and rows of tables no lines. Null texts count as empty.
    """
    q, a, t = (F.coalesce(c, F.lit("")) for c in (question, answer, article))
    said = F.concat(q, F.lit("\n"), a)
    words = F.filter(confusable_pairs(t, said), lambda p: ~p["a"].rlike(INFLECTED) & ~p["b"].rlike(INFLECTED))
    names = lambda text, term: F.contains(text, term) | F.contains(plain_symbols(text), term)
    pairs = F.concat(words, symbol_pairs(t, said), side_pairs(t, said))
    turned = F.transform(pairs, lambda p: F.when(names(a, p["a"]), F.struct(p["a"].alias("used"), p["b"].alias("other"))).otherwise(F.struct(p["b"].alias("used"), p["a"].alias("other"))))
    lines = F.filter(F.transform(F.split(t, LINES), lambda s: F.trim(s)), lambda s: (s != "") & ~F.contains(F.left(s, F.lit(LINE_CHARS)), F.lit("<t")))
    sentences = F.split(a, SENTENCES)
    numbers = lambda s: F.filter(F.transform(F.regexp_extract_all(s, F.lit(CLAIM), F.lit(0)), lambda n: F.regexp_replace(n, r"\s", "")), lambda n: F.length(n) >= 2)

    def of_number(pair, n):
        held = F.filter(lines, lambda s: F.contains(F.replace(s, F.lit(" ")), n))
        other = F.filter(held, lambda s: names(s, pair["other"]))
        wrong = (F.size(other) > 0) & ~F.exists(held, lambda s: names(s, pair["used"]))
        return F.when(wrong, F.struct(pair["used"].alias("used"), pair["other"].alias("expected"), n.alias("value"), F.left(F.get(other, F.lit(0)), F.lit(LINE_CHARS)).alias("article_line")))

    of_sentence = lambda pair, s: F.transform(numbers(s), lambda n: of_number(pair, n))
    of_pair = lambda pair: F.flatten(F.transform(F.filter(sentences, lambda s: names(s, pair["used"])), lambda s: of_sentence(pair, s)))
    return F.array_compact(F.flatten(F.transform(turned, of_pair)))


def standards(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PLACEHOLDER), F.lit(0)), lambda s: F.trim(F.regexp_replace(F.upper(s), r"[\s\-–—:]+", " "))))


def invented_standards(said: Column, evidence: Column) -> Column:
    """Standards without a real number that the evidence doesn't name."""
    return F.array_sort(F.array_except(standards(said), standards(evidence)))


def conclusion_issues(answer: Column, expected: Column) -> Column:
    """meta_talk, opposite_conclusion or both_conclusions where an answer doesn't end as its label says."""
    text = F.regexp_replace(F.coalesce(answer, F.lit("")), DENIED_DENIAL, "")
    yes, no = text.rlike(APPLIES), text.rlike(APPLIES_NOT)
    asked = expected.isin("applicable", "not_applicable")
    opposite = F.when(expected == "applicable", no & ~yes).otherwise(yes & ~no)
    issues = F.array(F.when(F.coalesce(answer, F.lit("")).rlike(META_TALK), "meta_talk"), F.when(asked & opposite, "opposite_conclusion"), F.when(asked & yes & no, "both_conclusions"))
    return F.array_compact(issues)


def incomplete(question: Column, answer: Column) -> Column:
    return (bare(question) == "") | (bare(answer) == "")


def best_sentence(article: Column, basis: Column, pattern: str = "[가-힣]{2,}", least: int = 20, most: int = 160) -> Column:
    """The sentence that shares most words with a basis, the first of equals; the text's beginning without sentences."""
    sentences = F.filter(F.transform(F.split(article, r"(?<=[다음])\.\s*|(?<=[a-z])\.\s+"), lambda s: F.trim(s)), lambda s: F.length(s) > least)
    words = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)))
    scored = F.transform(sentences, lambda s, i: F.struct(F.size(F.array_intersect(words(s), words(basis))).alias("n"), (-i).alias("i"), s.alias("s")))
    return F.left(F.coalesce(F.array_max(scored)["s"], F.left(article, F.lit(120))), F.lit(most))
