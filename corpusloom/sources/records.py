"""JSON-lines records in and out, resumable and tolerant reads, table formats by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "id string, text string, source string, lang string, metadata map<string,string>"


def read_records(spark: SparkSession, path: str, schema: str = RECORD, strict: bool = True) -> DataFrame:
    """Lines of JSON; blank ones are skipped. strict: a broken line fails the read, else it is left out."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def write_records(records: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object for each row, null fields left out."""
    records.select(F.to_json(F.struct(*[F.col(c) for c in records.columns]), {"ignoreNullFields": "true"}).alias("value")).write.mode(mode).text(path)


def read_corpus(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """Files of several folders, with the folder as publisher and the file's name without its ending."""
    parts = F.split(F.input_file_name(), "/")
    return spark.read.schema(schema).json(glob).withColumn("publisher", F.element_at(parts, -2)).withColumn("source_file", F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", ""))


def not_done(records: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Records whose key no earlier run has written."""
    return records.join(done.select(key).distinct(), key, "left_anti")


def write_table(records: DataFrame, path: str, form: str = "parquet", by: list[str] | None = None, replace_partitions: bool = False) -> None:
    """Any of Spark's file formats; with replace_partitions only the partitions that the rows hold are replaced."""
    writer = records.write.format(form).mode("overwrite")
    if replace_partitions:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*by) if by else writer).save(path)


def bucket_name(environment: str, domain: str, purpose: str) -> str:
    return f"{environment}-{domain}-{purpose}"
