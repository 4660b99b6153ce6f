"""Loaders of cases, training rows and prompts in their several shapes; ingest, resume, review and parent tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import content_hash, normalize_text
from corpusloom.operators.curation import exact_dedup
from corpusloom.operators.datasets import chat, present

CASE = "id string, question string, text string, expected string, response string, answer string, contexts array<string>"
CHAT = "messages array<struct<role:string,content:string>>, text string, response string, prompt string, chosen string, rejected string"


def _lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with their places: file by file, line by line."""
    read = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at")).where(F.trim("value") != "")
    return read.select("file", "at", F.from_json("value", schema).alias("r")).select("file", "at", "r.*")


def load_cases(spark: SparkSession, path: str) -> DataFrame:
    """id, question, expected, answer, contexts of the lines that ask something: question or text, expected or response;
    an id is c and the line's number where none is given."""
    rows = _lines(spark, path, CASE)
    number = F.row_number().over(Window.partitionBy("file").orderBy("at")) - 1
    made = rows.withColumn("number", number).select(F.coalesce(F.nullif("id", F.lit("")), F.concat(F.lit("c"), "number")).alias("id"), present(F.col("question"), F.col("text")).alias("question"), present(F.col("expected"), F.col("response")).alias("expected"), "answer", "contexts")
    return made.where("question IS NOT NULL")


def load_chats(spark: SparkSession, path: str) -> DataFrame:
    """messages of each line: as given, or a question and its response."""
    rows = _lines(spark, path, CHAT)
    pair = F.when(present(F.col("text")).isNotNull() & present(F.col("response")).isNotNull(), chat(None, F.col("text"), F.col("response")))
    return rows.select(F.coalesce("messages", pair).alias("messages")).where("messages IS NOT NULL")


def load_preferences(spark: SparkSession, path: str) -> DataFrame:
    """prompt, chosen, rejected of the lines that have all three."""
    names = ("prompt", "chosen", "rejected")
    return _lines(spark, path, CHAT).where(" AND ".join(f"coalesce({n}, '') <> ''" for n in names)).select(*names)


def load_prompts(spark: SparkSession, path: str) -> DataFrame:
    """Rows with a prompt: theirs, their text, or the first question of their messages; other columns stay, and rows of
    different shapes take all names that any of them has."""
    rows = spark.read.json(path)
    have = lambda n: F.col(n) if n in rows.columns else F.lit(None)
    asked = F.get(F.filter("messages", lambda m: m["role"] == "user"), F.lit(0))["content"] if "messages" in rows.columns else F.lit(None).cast("string")
    made = rows.withColumn("prompt", present(have("prompt").cast("string"), have("text").cast("string"), asked))
    return made.where("prompt IS NOT NULL").drop("text", "messages")


def ingest(spark: SparkSession, source: str, target: str, form: str = "parquet", order: str = "id", parts: int | None = None) -> int:
    """Read JSON records, normalise, keep the first of each text, write; the number of rows written. They are counted in
    what was written, so nothing is read or hashed twice."""
    records = spark.read.json(source)
    kept = exact_dedup(records.withColumn("text", normalize_text(F.col("text"))), order)
    (kept.repartition(parts) if parts else kept).write.format(form).mode("overwrite").save(target)
    return spark.read.format(form).load(target).count()


def append_new(records: DataFrame, path: str, key: str = "id") -> None:
    """Append the records whose key no earlier run has written. The folder may be empty or not there yet."""
    spark = records.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        records = records.join(spark.read.schema(records.schema).json(path).select(key).distinct(), key, "left_anti").select(*records.columns)
    records.write.mode("append").json(path)


def review_tables(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, chunks) of a review: each document with its place by name, its chunks and articles; each chunk with
    its place in the document. chunks: doc, chunk_id, chunk_level, ord, ..."""
    counts = chunks.groupBy("doc").agg(F.count("*").alias("n_chunks"), F.count_if(F.col("chunk_level") == "parent").alias("n_articles"))
    documents = counts.withColumn("idx", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("doc")) - 1)  # a row for each document
    return documents, chunks.withColumn("seq", F.row_number().over(Window.partitionBy("doc").orderBy("ord")) - 1)


def article_units(chunks: DataFrame) -> DataFrame:
    """(chunk_id, n_units): articles with the number of their children, none included."""
    children = chunks.where("chunk_level = 'child'").groupBy(F.col("parent_chunk_id").alias("of")).agg(F.count("*").alias("n"))
    return chunks.where("chunk_level = 'parent'").join(children, F.col("chunk_id") == F.col("of"), "left").select("chunk_id", F.coalesce("n", F.lit(0)).alias("n_units"))


def parent_store(parents: DataFrame, order: str = "ord") -> DataFrame:
    """The last row of each parent: what a store that replaces by id holds in the end."""
    return parents.groupBy("chunk_id").agg(F.max_by(F.struct(*parents.columns), order).alias("x")).select("x.*")


def write_splits(rows: DataFrame, path: str) -> None:
    """kind and split as folders of JSON lines."""
    rows.write.mode("overwrite").partitionBy("kind", "split").json(path)


def index_points(chunks: DataFrame, encode, path: str, order: str = "ord") -> None:
    """Write embedded chunks (doc_id, chunk_id, text, ...) by document, first of equal texts; documents that are written
    again replace their own folders. encode: a function of the text column to vectors."""
    first = exact_dedup(chunks.where(F.trim("text") != ""), order)
    first.withColumn("embedding", encode(F.col("text"))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc_id").parquet(path)


# publishers' names and codes.
PUBLISHER_CODES = {
    "한국선급": "KR", "korean register": "KR", "classnk (nk)": "NK", "classnk": "NK", "nippon kaiji kyokai": "NK", "lloyd's register": "LR", "lloyd’s register": "LR", "dnv": "DNV", "bureau veritas (bv)": "BV", "bureau veritas": "BV", "iacs": "IACS", "abs": "ABS",
}


def publisher_code(name: Column) -> Column:
    """A publisher's code; the name itself, trimmed, where it has none."""
    codes = F.create_map(*[F.lit(x) for kv in PUBLISHER_CODES.items() for x in kv])
    return F.coalesce(F.try_element_at(codes, F.lower(F.trim(name))), F.trim(F.coalesce(name, F.lit(""))))


def embed_text(chunk_type: Column, retrieval: Column, path: Column, paragraph: Column, heading: Column, content: Column, item: Column, sub_item: Column) -> Column:
    """What of a chunk is embedded: a table's or figure's own text; else path, heading and content, and for items the
    paragraph that leads to them, unless it is there already."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    leads = (blank(paragraph) != "") & ((blank(item) != "") | (blank(sub_item) != "")) & (blank(paragraph) != blank(heading)) & ~F.startswith(blank(content), blank(paragraph))
    parts = F.filter(F.array(F.array_join(F.coalesce(path, F.array().cast("array<string>")), " > "), F.when(leads, paragraph).otherwise(""), blank(heading), blank(content)), lambda x: x != "")
    return F.when(chunk_type.isin("table", "figure"), F.coalesce(F.nullif(retrieval, F.lit("")), blank(content))).otherwise(F.array_join(parts, "\n"))


def hashed_records(records: DataFrame) -> DataFrame:
    return records.withColumn("content_hash", content_hash(F.col("text")))
