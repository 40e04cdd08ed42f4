"""Readers for stored tables, paper folders and landed payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


SPREAD_KEY = "spark.paperloom.spread"


def read_table(spark: SparkSession, path: str, spread: str | None = None) -> DataFrame:
    """Read parquet.

    ``spread`` names the key to hash on where the session asks for it: whoever runs on files
    of fewer splits than cores sets ``spark.paperloom.spread`` to a number of partitions.
    It is unset by default, so large file sets are read without a shuffle.
    """
    df = spark.read.parquet(path)
    parts = spark.conf.get(SPREAD_KEY, None) if spread else None
    return df.repartition(int(parts), spread) if parts else df


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Stored papers or chunks as retrieval documents."""
    return read_table(spark, path, spread="doc_id").select("doc_id", "text", "lang", "source")


def list_papers(spark: SparkSession, folder: str, suffix: str = "pdf") -> tuple[DataFrame, DataFrame]:
    """Files of a folder sorted by name: those with the suffix, and the rejected rest.

    Only path and size are asked for, so file contents are never read.
    """
    files = spark.read.format("binaryFile").load(folder).select(
        F.regexp_replace("path", "^.*/", "").alias("name"),
        F.col("length").alias("size"),
    )
    wanted = F.lower("name").endswith(f".{suffix}")
    accepted = files.where(wanted).withColumn("status", F.lit("indexed"))
    rejected = files.where(~wanted).withColumn("status", F.lit("rejected"))
    return accepted.orderBy("name"), rejected.orderBy("name")


PAYLOAD_SCHEMA = "source string, query_id long, fetched_at timestamp_ntz, payload string"


def write_payloads(payloads: DataFrame, folder: str) -> None:
    """Land API answers as JSON lines, one folder per source, so readers prune by source."""
    payloads.write.mode("append").partitionBy("source").json(folder)


def read_payloads(spark: SparkSession, folder: str, source: str | None = None) -> DataFrame:
    """Landed answers ``(source, query_id, fetched_at, payload)``, one row per answer."""
    df = spark.read.schema(PAYLOAD_SCHEMA).json(folder)
    return df if source is None else df.where(F.col("source") == source)


def read_whole_files(spark: SparkSession, folder: str, source: str) -> DataFrame:
    """Answers stored one per file (XML or JSON): the file name is the request."""
    return spark.read.option("wholetext", True).text(folder).select(
        F.lit(source).alias("source"),
        F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("request"),
        F.col("_metadata.file_modification_time").alias("fetched_at"),
        F.col("value").alias("payload"),
    )
