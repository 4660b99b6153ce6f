"""Text, hash and bucket expressions; all stay in the JVM but for NFKC of texts beyond ASCII."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The white space of Unicode, control separators included.
SPACES = r"[\s\x1c-\x1f\x85\p{Z}]+"
TOKEN = "[0-9A-Za-z가-힣]+"
HANGUL = "[가-힣]"


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def nfkc(text: Column) -> Column:
    """NFKC; only texts with characters beyond ASCII leave the JVM's expressions."""
    wide = F.when(text.rlike(r"[^\x00-\x7F]"), text)
    return F.when(wide.isNotNull(), _nfkc(wide)).otherwise(text)


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACES, " "))


def normalize_text(text: Column) -> Column:
    """NFKC, white space runs as one blank, ends trimmed."""
    return squeeze(nfkc(text))


def content_hash(text: Column, normalized: bool = False) -> Column:
    return F.sha2(text if normalized else normalize_text(text), 256)


def eval_form(text: Column) -> Column:
    """Lower case, blanks squeezed; null counts as empty."""
    return squeeze(F.lower(F.coalesce(text, F.lit(""))))


def char_units(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), SPACES, ""), ""), lambda c: c != "")


def token_units(text: Column) -> Column:
    """Words of the evaluation form; a single word of several characters counts by characters."""
    form = eval_form(text)
    words = F.filter(F.split(form, " "), lambda w: w != "")
    return F.when((F.size(words) == 1) & (F.length(form) > 1), F.filter(F.split(form, ""), lambda c: c != "")).otherwise(words)


def hex_number(hexed: Column) -> Column:
    return F.conv(hexed, 16, 10).cast("bigint")


def stable_bucket(key: Column, seed: str = "42", algorithm: str = "md5") -> Column:
    """A number from 0 to 1 by the first 32 bits of a hash of 'seed:key'."""
    named = F.concat(F.lit(f"{seed}:"), key.cast("string"))
    hexed = F.md5(named) if algorithm == "md5" else F.sha2(named, 256)
    return hex_number(F.substring(hexed, 1, 8)) / F.lit(4294967295.0)


def split_name(bucket: Column, test: float, validation: float, order=("test", "validation", "train")) -> Column:
    """The first split up to its share, the second up to the sum, the third beyond (a bucket of 1 included)."""
    return F.when(bucket < test, order[0]).when(bucket < test + validation, order[1]).otherwise(order[2])


def hash_parity(text: Column) -> Column:
    """0 or 1 by the last hex digit of SHA-256."""
    return (hex_number(F.substring(F.sha2(text, 256), 64, 1)) % 2).cast("int")


def slug(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^0-9a-z가-힣]+", "-"), F.lit("-"))


def group_key(text: Column) -> Column:
    """A grouping key: NFKC, lower case, separators as single hyphens, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(nfkc(text)), r"[\s_/\\.,:;()\[\]]+", "-"), "-{2,}|^-+|-+$", "-").substr(F.lit(1), F.lit(1 << 20))


def canonical_group(source: str, key: Column) -> Column:
    return F.concat(F.lit("crg_"), F.substring(F.sha2(F.concat(F.lit(f"{source}:"), key), 256), 1, 16))


def script_language(text: Column, least: int = 20) -> Column:
    """ko, en or unknown by the larger share of Hangul and Latin letters; short texts are unknown."""
    hangul, latin = F.regexp_count(text, F.lit(HANGUL)), F.regexp_count(text, F.lit("[A-Za-z]"))
    return F.when((F.length(text) < least) | (hangul + latin == 0), "unknown").when(hangul >= latin, "ko").otherwise("en")


def strip_years(path: Column) -> Column:
    """A section path without years and white space: editions of one article fall together."""
    return F.regexp_replace(F.regexp_replace(path, r"[\s(_]?(19|20)\d{2}[)\s]?", ""), SPACES, "")


def strip_markup(html: Column) -> Column:
    """Readable text of HTML: scripts, styles and comments go, tags become blanks, common entities are decoded."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    bare = F.regexp_replace(bare, r"(?s)<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(name), F.lit(char))
    return squeeze(bare)


def render_prompt(template: Column, values: dict[str, Column]) -> Column:
    """Each {name} by its value; names without a value stay."""
    out = template
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def number_set(text: Column) -> Column:
    """Distinct numbers of a text, thousands separators removed."""
    found = F.regexp_extract_all(text, F.lit(r"\d+(?:,\d{3})*(?:\.\d+)?"), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, lambda n: F.replace(n, F.lit(","), F.lit("")))))


def unsupported_numbers(answer: Column, evidence: Column) -> Column:
    """Numbers of the answer that the evidence does not hold."""
    return F.array_except(number_set(answer), number_set(evidence))


def quote_contained(quote: Column, source: Column, prefix: int = 40, window: int = 15, share: float = 0.5) -> Column:
    """Whether a quote stands in a source: whole, by its first `prefix` characters, or by enough of its windows."""
    q, s = F.regexp_replace(quote, SPACES, ""), F.regexp_replace(source, SPACES, "")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor(F.length(q) / window).cast("int") - 1))
    hits = F.size(F.filter(starts, lambda i: F.contains(s, F.substr(q, i * window + 1, F.lit(window)))))
    long_enough = F.length(q) >= window
    return F.coalesce(F.when(F.length(q) == 0, False).otherwise(F.contains(s, q) | ((F.length(q) >= prefix) & F.contains(s, F.substr(q, F.lit(1), F.lit(prefix)))) | (long_enough & (hits >= share * F.size(starts)))), F.lit(False))
