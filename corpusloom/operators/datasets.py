"""Chat, preference and other training rows; splits, fingerprints, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROLES = ("system", "user", "assistant")
SUMMARY_SYSTEM = "Summarize the document."


def present(*columns: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chat(system: Column | None, user: Column, assistant: Column) -> Column:
    """[system?] user assistant."""
    parts = [message("user", user), message("assistant", assistant)]
    if system is None:
        return F.array(*parts)
    return F.array_compact(F.array(F.when(present(system).isNotNull(), message("system", system)), *parts))


def sft_rows(records: DataFrame, system: str | None = None, user: Column | None = None, answer: Column | None = None) -> DataFrame:
    """Records with both sides present, as messages."""
    user = present(F.col("text")) if user is None else user
    answer = present(F.col("response")) if answer is None else answer
    kept = records.where(user.isNotNull() & answer.isNotNull())
    return kept.withColumn("messages", chat(F.lit(system) if system else None, user, answer))


def preference_rows(records: DataFrame) -> DataFrame:
    names = ("prompt", "chosen", "rejected")
    return records.where(" AND ".join(f"coalesce({n}, '') <> ''" for n in names)).select(*names)


def rag_rows(records: DataFrame) -> DataFrame:
    """question or text, answer or response; contexts become the system message."""
    context = F.nullif(F.array_join(F.coalesce("contexts", F.array().cast("array<string>")), "\n\n"), F.lit(""))
    user, answer = present(F.col("question"), F.col("text")), present(F.col("answer"), F.col("response"))
    return records.where(user.isNotNull() & answer.isNotNull()).withColumn("messages", chat(context, user, answer))


def translation_rows(records: DataFrame) -> DataFrame:
    order = F.concat(F.lit("Translate from "), F.coalesce("src_lang", F.lit("source")), F.lit(" to "), F.coalesce("tgt_lang", F.lit("target")), F.lit(":\n"), F.col("source"))
    return records.where("coalesce(source, '') <> '' AND coalesce(target, '') <> ''").withColumn("messages", chat(None, order, F.col("target")))


def summary_rows(records: DataFrame) -> DataFrame:
    return records.where("coalesce(document, '') <> '' AND coalesce(summary, '') <> ''").withColumn("messages", chat(F.lit(SUMMARY_SYSTEM), F.col("document"), F.col("summary")))


def reasoning_rows(records: DataFrame, tags: bool = True) -> DataFrame:
    """Reasoning before the answer, in think tags or as plain paragraphs."""
    why, answer = present(F.col("reasoning")), present(F.col("answer"), F.col("response"))
    whole = F.concat(F.lit("<think>"), why, F.lit("</think>\n"), answer) if tags else F.concat(why, F.lit("\n\n"), answer)
    user = present(F.col("question"), F.col("text"))
    return records.where(user.isNotNull() & answer.isNotNull()).withColumn("messages", chat(None, user, F.when(why.isNull(), answer).otherwise(whole)))


def verdict_rows(records: DataFrame) -> DataFrame:
    """verdict, answer or response as the answer, reasoning without tags."""
    return reasoning_rows(records.withColumn("answer", present(F.col("verdict"), F.col("answer"), F.col("response"))), tags=False)


def tool_rows(records: DataFrame, order: str = "ord") -> DataFrame:
    """A call of a tool, its result if there is one, and then the answer if there is one."""
    call_id = F.coalesce("tool_call_id", F.concat(F.lit("call_"), F.col(order).cast("string")))
    call = F.to_json(F.struct(call_id.alias("id"), F.struct(F.col("tool_name").alias("name"), F.col("arguments").alias("arguments")).alias("function")))
    line = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    result = present(F.col("result"))
    messages = F.array_compact(F.array(line("user", F.col("question")), line("assistant", call), F.when(result.isNotNull(), line("tool", result)), F.when(result.isNotNull() & present(F.col("answer")).isNotNull(), line("assistant", F.col("answer")))))
    return records.where("coalesce(question, '') <> '' AND coalesce(tool_name, '') <> ''").withColumn("messages", messages)


def dialogue_rows(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each conversation with a user and an assistant turn: its valid turns in order."""
    valid = turns.where(F.col(role).isin(*ROLES) & (F.coalesce(F.col(text), F.lit("")) != ""))
    rows = valid.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("turn"), F.col(role).alias("role"), F.col(text).alias("content")))).alias("turns"))
    said = lambda who: F.exists("turns", lambda t: t["role"] == who)
    return rows.where(said("user") & said("assistant")).select(key, F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("messages"))


def last_answer(messages: str = "messages") -> Column:
    return F.try_element_at(F.filter(messages, lambda m: m["role"] == "assistant"), F.lit(-1))["content"]


def filter_answer_length(rows: DataFrame, least: int = 1, most: int = 20_000) -> DataFrame:
    return rows.where(F.coalesce(F.length(last_answer()), F.lit(0)).between(least, most))


def fingerprint(rows: DataFrame) -> DataFrame:
    """SHA-256 over the sorted JSON lines of rows, each with a newline: the same for any order of rows.

    The lines meet in one row, which holds 2 GB at most; fingerprint_tree has no such limit.
    """
    line = F.to_json(F.struct(*[F.col(c) for c in rows.columns]))
    return rows.agg(F.sha2(F.concat(F.array_join(F.array_sort(F.collect_list(line)), "\n"), F.lit("\n")), 256).alias("fingerprint"), F.count("*").alias("n"))


def fingerprint_tree(rows: DataFrame, buckets: int = 4096) -> DataFrame:
    """A fingerprint for any size: sorted line hashes of each bucket, then of the buckets; order plays no part."""
    hashed = rows.select(F.sha2(F.to_json(F.struct(*[F.col(c) for c in rows.columns])), 256).alias("h"))
    leaves = hashed.withColumn("b", F.pmod(F.xxhash64("h"), F.lit(buckets))).groupBy("b").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "\n"), 256).alias("leaf"), F.count("*").alias("n"))
    return leaves.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "leaf"))), lambda x: x["leaf"]), "\n"), 256).alias("fingerprint"), F.sum("n").alias("n"))


def manifest(rows: DataFrame, split: str = "split") -> DataFrame:
    """Rows of each split, with the total."""
    return rows.groupBy(split).agg(F.count("*").alias("n")).withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(1))))


def split_leaks(rows: DataFrame, keys: dict[str, str], split: str = "split") -> DataFrame:
    """For each key (name -> 'fail' or 'warn'), how many of its values stand in several splits."""
    parts = [rows.where(F.col(k).isNotNull()).groupBy(F.col(k).cast("string").alias("value")).agg(F.count_distinct(split).alias("n")).agg(F.count_if(F.col("n") > 1).alias("leaks")).select(F.lit(k).alias("key"), F.lit(level).alias("level"), "leaks") for k, level in keys.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("status", F.when(F.col("leaks") == 0, "pass").otherwise(F.col("level")))


def quota_split(rows: DataFrame, track: str, order: Column, quota: int, validation: int) -> DataFrame:
    """In each track the first `quota` by order, the first `validation` of them for validation; the rest are
    surplus, which fills the shortage of tracks below quota in one global order."""
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(track).orderBy(order)))
    chosen = ranked.where(F.col("_r") <= quota).withColumn("split", F.when(F.col("_r") <= validation, "validation").otherwise("train"))
    short = ranked.groupBy(track).agg(F.greatest(quota - F.count("*"), F.lit(0)).alias("lack")).agg(F.coalesce(F.sum("lack"), F.lit(0)).alias("lack"))
    surplus = ranked.where(F.col("_r") > quota).withColumn("_g", F.row_number().over(Window.orderBy(order)))
    filled = surplus.crossJoin(F.broadcast(short)).where(F.col("_g") <= F.col("lack")).drop("_g", "lack").withColumn("split", F.lit("backfill"))
    return chosen.unionByName(filled).drop("_r")
