"""Where quotes stand in their articles, and quotes brought back to the article's own wording."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from corpusloom.functions.text import SPACES

ELLIPSIS = re.compile(r"\s*(?:\.{3,}|…|⋯)\s*")
#: Code points that are white space; all lie in the first plane.
_SPACES = np.array([c for c in range(0x10000) if chr(c).isspace()], dtype=np.uint32)
SPAN = StructType().add("start", IntegerType()).add("end", IntegerType()).add("snapped", StringType())
#: A snapped quote: blocks of so many characters, covering so much of the quote, in a stretch so many times its length; quotes from so many characters on.
BLOCK, SHARE, STRETCH, LEAST = 4, 0.85, 1.5, 10


def squeezed(text: str) -> tuple[str, np.ndarray]:
    """A text without white space, and where each of its characters stood."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    at = np.flatnonzero(~np.isin(points, _SPACES))
    return points[at].tobytes().decode("utf-32-le", "surrogatepass"), at


def find_span(quote: str, text: str, flat: tuple[str, np.ndarray] | None = None) -> tuple[int, int]:
    """Start and end of a quote in a text: as it is, else white space aside, else from the first to the last of its
    pieces between ellipses, if they stand there in order. (-1, -1) where it doesn't stand."""
    if not quote:
        return -1, -1
    if (at := text.find(quote)) >= 0:
        return at, at + len(quote)
    hay, place = flat or squeezed(text)
    whole = squeezed(quote)[0]
    pieces = [p for p in (squeezed(x)[0] for x in ELLIPSIS.split(quote)) if p]
    for parts in ([whole], pieces):
        first, end = -1, 0
        for part in parts:
            at = hay.find(part, end) if part else -1
            if at < 0:
                break
            first, end = at if first < 0 else first, at + len(part)
        else:
            if first >= 0:
                return int(place[first]), int(place[end - 1]) + 1
    return -1, -1


def _seeds(needle: str, hay: str) -> float:
    """The share of a needle's characters that lie in a run of BLOCK which the hay has too: no matching can cover more."""
    held = np.zeros(len(needle), dtype=bool)
    for i in range(len(needle) - BLOCK + 1):
        if not held[i : i + BLOCK].all() and needle[i : i + BLOCK] in hay:
            held[i : i + BLOCK] = True
    return held.sum() / len(needle)


def snap(quote: str, text: str, flat: tuple[str, np.ndarray] | None = None) -> str | None:
    """The text's own wording of a quote that was slightly changed: the stretch between the first and the last block of
    BLOCK characters or more that both have, if blocks cover SHARE of the quote and the stretch isn't longer than STRETCH times it."""
    (hay, place), needle = flat or squeezed(text), squeezed(quote or "")[0]
    if len(needle) < LEAST or not hay or _seeds(needle, hay) < SHARE:
        return None
    blocks = [b for b in SequenceMatcher(None, hay, needle, autojunk=False).get_matching_blocks() if b.size >= BLOCK]
    if not blocks or sum(b.size for b in blocks) < SHARE * len(needle):
        return None
    first, last = blocks[0].a, blocks[-1].a + blocks[-1].size
    return text[place[first] : place[last - 1] + 1] if last - first <= STRETCH * len(needle) else None


@F.pandas_udf(SPAN)
def _spans(quotes: pd.Series, texts: pd.Series) -> pd.DataFrame:
    out = []
    for quote, text in zip(quotes, texts, strict=True):
        if quote is None or text is None:
            out.append((-1, -1, None))
            continue
        flat = squeezed(text)
        start, end = find_span(quote, text, flat)
        snapped = snap(quote, text, flat) if start < 0 else None
        if snapped:
            start, end = find_span(snapped, text, flat)
        out.append((start, end, snapped))
    return pd.DataFrame(out, columns=["start", "end", "snapped"])


def text_language(text: Column, chars: int = 2000, least: int = 20) -> Column:
    """ko or en by the letters of a text's beginning; unknown with few of them."""
    head = F.left(F.coalesce(text, F.lit("")), F.lit(chars))
    hangul, latin = F.regexp_count(head, F.lit("[가-힣]")), F.regexp_count(head, F.lit("[A-Za-z]"))
    return F.when(hangul + latin < least, "unknown").when(hangul >= latin, "ko").otherwise("en")


def provision_id(chunk_id: Column) -> Column:
    """KR_RULE_P10_C7 as KR:P10:C7; empty where no rule is named."""
    tail = F.substring_index(chunk_id, "_RULE_", 1)
    rest = F.regexp_replace(chunk_id, r"^.*?_RULE_", "")
    return F.when(F.contains(chunk_id, F.lit("_RULE_")), F.concat_ws(":", F.substring_index(tail, "_", 1), F.replace(rest, F.lit("_"), F.lit(":")))).otherwise("")


def evidence_meta(rows: DataFrame, quote: str = "quote", text: str = "article_text", chunk: str | None = "chunk_id") -> DataFrame:
    """rows with quote (in the article's wording if it had to be snapped), quote_raw (then the quote as it was),
    quote_snapped, char_start, char_end (-1 if it doesn't stand there), normalized_quote, quote_hash,
    evidence_language and, with `chunk`, provision_id.

    Only quotes that don't stand in their article as they are leave the JVM. A null or empty quote stands nowhere and
    has no hash. Positions count code points.
    """
    lost = (F.col("__at") == 0) | (F.length(quote) == 0)
    found = rows.withColumn("__at", F.coalesce(F.expr(f"instr(`{text}`, `{quote}`)"), F.lit(0)))
    found = found.withColumn("__span", F.when(lost, _spans(F.when(lost, F.col(quote)), F.when(lost, F.col(text)))))
    snapped = F.col("__span.snapped").isNotNull()
    used = F.when(snapped, F.col("__span.snapped")).otherwise(F.col(quote))
    plain = F.regexp_replace(F.coalesce(used, F.lit("")), SPACES, "")
    start = F.coalesce("__span.start", F.col("__at") - 1)
    end = F.coalesce("__span.end", F.col("__at") - 1 + F.length(quote))
    made = {"quote_raw": F.when(snapped, F.col(quote)), "quote_snapped": snapped, "char_start": start, "char_end": end, "normalized_quote": plain, "quote_hash": F.when(plain != "", F.left(F.sha1(plain), F.lit(12))).otherwise(""), "evidence_language": text_language(F.col(text)), "quote": used}
    if chunk:
        made["provision_id"] = provision_id(F.coalesce(chunk, F.lit("")))
    return found.withColumns(made).drop("__at", "__span")
