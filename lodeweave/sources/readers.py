"""Readers with declared schemas. Filters given here reach the parquet scan."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
PAGES = "page_id bigint, url string, html string"
TURNS = "conv_id bigint, turn bigint, role string, text string"
VECTORS = "vec_id bigint, embedding array<float>, label int"
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
BENCHMARK = "item_id bigint, text string"


def table(spark: SparkSession, sf_dir: str, name: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def widen(df: DataFrame, *keys: str) -> DataFrame:
    """Spread a table that has fewer splits than the session has cores, by its unique
    ``keys``. Large tables have more splits than that and are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def read_documents(
    spark: SparkSession,
    sf_dir: str,
    lang: Iterable[str] | None = None,
    source: Iterable[str] | None = None,
) -> DataFrame:
    docs = table(spark, sf_dir, "documents", DOCUMENTS)
    if lang is not None:
        docs = docs.where(F.col("lang").isin(list(lang)))
    if source is not None:
        docs = docs.where(F.col("source").isin(list(source)))
    return widen(docs, "doc_id")


def read_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", PAGES)
    return pages.select(
        "page_id",
        "url",
        F.parse_url("url", F.lit("PROTOCOL")).alias("scheme"),
        F.parse_url("url", F.lit("HOST")).alias("host"),
        F.parse_url("url", F.lit("PATH")).alias("path"),
        F.parse_url("url", F.lit("QUERY")).alias("query"),
        F.parse_url("url", F.lit("REF")).alias("fragment"),
        "html",
    )


def read_turns(spark: SparkSession, sf_dir: str, roles: Iterable[str] | None = None) -> DataFrame:
    turns = table(spark, sf_dir, "conversations", TURNS)
    return turns if roles is None else turns.where(F.col("role").isin(list(roles)))


def read_vectors(spark: SparkSession, sf_dir: str, dim: int = 64) -> DataFrame:
    """Vectors of the wanted size; other sizes are rejected."""
    vectors = table(spark, sf_dir, "embeddings", VECTORS)
    return widen(vectors.where(F.size("embedding") == dim), "vec_id")


def read_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark", BENCHMARK)
    return items.select(F.col("item_id").alias("q_id"), "text")


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events", EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))


def stream_path(sf_dir: str, name: str) -> str:
    """Path of one table for a stream. The file source takes a folder or a pattern; as a
    pattern the name may be either a file or a folder of files."""
    return f"{sf_dir.rstrip('/')}/{name}.parque[t]"


def stream_events(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Event files as a stream; ``ts`` becomes a timestamp so that it can carry a watermark."""
    reader = spark.readStream.schema(EVENTS)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def stream_documents(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(DOCUMENTS)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    return reader.parquet(path)
