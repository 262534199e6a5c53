"""Helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.session import stored

# Fixed value: the separators between words, \x20 and \x09 to \x0D.
SPACES = r"[\x20\x09-\x0D]+"

# Spark's own switch for dropping a statement's shuffle files when the statement ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# Texts are handed to numpy in pieces of about this many bytes, whatever the batch holds.
PIECE_BYTES = 3_000_000


@contextmanager
def _setting(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` in the shared folder and read it back. The shuffle files behind it are dropped
    at once: nothing reads them again, and the written table is what a lost executor leaves whole."""
    with _setting(df.sparkSession, _CLEANUP, "true"):
        return stored(df, name)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words(text: Column) -> Column:
    """The words of a text, in order; an empty array for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def sample(rows: DataFrame, key: Column, most: int) -> DataFrame:
    """At most ``most`` rows, those with the least hash of ``key``. Rows that cannot be among them are left out before
    the sort, by the share of the hashes that holds four times as many, so few rows meet in its last task
    however many partitions there are."""
    share = min(1.0, 4 * most / max(rows.count(), 1))
    place = F.pmod(F.xxhash64(key), F.lit(1 << 40))
    return rows.where(place <= int(share * (1 << 40))).orderBy(place).limit(most)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def pieces(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that ``column`` holds about ``PIECE_BYTES`` in each."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        texts = batch.column(batch.schema.get_field_index(column))
        ends = np.cumsum(_lengths(texts))
        at = 0
        while at < n:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + PIECE_BYTES, side="right")))
            yield batch.slice(at, to - at)
            at = to


def _lengths(texts: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def flat_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts in one array, and the number of words in each text."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = lists.flatten()
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    seen = np.concatenate(([0], np.cumsum(full)))
    counts = seen[offsets[1:] - offsets[0]] - seen[offsets[:-1] - offsets[0]]
    return flat.filter(pa.array(full)), counts


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
