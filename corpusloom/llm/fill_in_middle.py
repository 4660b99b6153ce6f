"""Fill-in-the-middle by lines, in SQL functions alone.

A text is cut into lines; two cuts drawn from a keyed hash of the document's id part the lines into prefix, middle
and suffix, which are put in one of two orders behind sentinels. Nothing is shuffled and nothing leaves the JVM:
each row's arrangement follows from its own id and text, so a lost executor's rows are made anew alike.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentinels before the prefix, the suffix and the middle; a unit; hex digits of one number of the hash.
SENTINELS = ("<P>", "<S>", "<M>")
UNIT = r"[^\n]*\n|[^\n]+"
DIGITS = 8
COLUMNS = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")


def _number(digest: Column, k: int) -> Column:
    """The k-th group of hex digits, from 0, as an unsigned integer."""
    return F.conv(F.substring(digest, 1 + DIGITS * k, DIGITS), 16, 10).cast("long")


def _checked(sentinels: tuple[str, str, str]) -> str:
    """A pattern that finds the sentinels. One inside another, or one whose end another begins with, could be found
    where it wasn't put; so they must not share their ends."""
    if len(set(sentinels)) < 3 or not all(sentinels):
        raise ValueError("three different sentinels are needed")
    for a in sentinels:
        for b in sentinels:
            ends = range(1, min(len(a), len(b)) + (a != b))
            if (a != b and a in b) or any(a.endswith(b[:k]) for k in ends):
                raise ValueError(f"sentinels {a} and {b} overlap")
    return "|".join(re.escape(x) for x in sentinels)


def fill_in_middle(docs: DataFrame, *, seed: int = 7, rate: int = 100, spm: int = 50, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """doc_id, n (lines), form (plain, psm or spm), prefix_chars, middle_chars (null if plain), output: one row for
    each row of docs.

    rate: per cent of texts that are rearranged; spm: per cent of those with the suffix first. A null or empty text,
    and one that holds a sentinel, stays plain. A null id hashes like an empty one. Repeated rows are arranged
    alike. Only doc_id and text are read, so other columns may have any name; an empty table gives no rows. A very
    long text, or line, is one row as any other.
    """
    found = _checked(sentinels)
    text, digest = F.coalesce(F.col("text").cast("string"), F.lit("")), F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), digest.alias("digest"))
    cut = rows.select("doc_id", "text", "digest", F.regexp_extract_all("text", F.lit(UNIT), F.lit(0)).alias("units"))
    n = F.size("units")
    draws = [_number(F.col("digest"), k) for k in range(4)]
    plain = (F.col("text") == "") | F.col("text").rlike(found) | (draws[2] % 100 >= rate)
    ends = [(d % (n + 1)).cast("int") for d in draws[:2]]
    placed = cut.select(
        "doc_id", "text", "units", n.cast("long").alias("n"), F.least(*ends).alias("a"), F.greatest(*ends).alias("b"),
        F.when(plain, "plain").when(draws[3] % 100 < spm, "spm").otherwise("psm").alias("form"))
    part = lambda start, length: F.array_join(F.slice("units", start, length), "")
    parts = placed.select(
        "doc_id", "text", "n", "form", part(F.lit(1), F.col("a")).alias("prefix"), part(F.col("a") + 1, F.col("b") - F.col("a")).alias("middle"),
        part(F.col("b") + 1, (F.col("n") - F.col("b")).cast("int")).alias("suffix"))
    p, s, m = (F.lit(x) for x in sentinels)
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(p, "prefix", s, "suffix", m, "middle")).otherwise(F.concat(s, "suffix", p, "prefix", m, "middle"))
    chars = lambda c: F.when(F.col("form") != "plain", F.length(c).cast("long"))
    return parts.select("doc_id", "n", "form", chars("prefix").alias("prefix_chars"), chars("middle").alias("middle_chars"), output.alias("output"))


def restored(form: Column, output: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output of some form was made from, by its sentinels. A null form or output gives null."""
    parts = F.split(output, _checked(sentinels), 4)
    order = F.when(form == "psm", F.array(F.lit(1), F.lit(3), F.lit(2))).when(form == "spm", F.array(F.lit(2), F.lit(3), F.lit(1)))
    return F.when(form == "plain", output).otherwise(F.array_join(F.transform(order, lambda k: F.get(parts, k)), ""))


def digests(arranged: DataFrame, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """What fill_in_middle gives, with sha256 of the output and of the text restored from it, in place of the output."""
    back = arranged.select("*", restored(F.col("form"), F.col("output"), sentinels).alias("back"))
    return back.select(*[c for c in COLUMNS if c != "output"], F.sha2("output", 256).alias("output_sha256"), F.sha2("back", 256).alias("restored_sha256"))


def oracle() -> str:
    """The same in DuckDB's SQL, the parts taken by lines and the restored text as the text itself."""
    draws = ", ".join(f"CAST('0x' || substr(h, {1 + DIGITS * k}, {DIGITS}) AS BIGINT) AS h{k + 1}" for k in range(4))
    joined = lambda a, b: f"coalesce(array_to_string(u[{a}:{b}], ''), '')"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
k AS (SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n, {draws} FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT doc_id, t, n, form, {joined('1', 'a')} AS pre, {joined('a + 1', 'b')} AS mid, {joined('b + 1', 'n')} AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM p"""
