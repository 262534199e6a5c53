"""Index tables on shared storage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def write_index(df: DataFrame, path: str, keys: Sequence[str] = (), by: Sequence[str] = (), mode: str = "overwrite") -> str:
    """Write ``df`` as parquet: range-sorted on ``keys`` so that row-group
    statistics prune look-ups, in folders per value of the low-cardinality columns ``by``.

    Range partitioning samples the key, so a key holding a third of the rows gets
    neighbours of its own size but no row leaves its range; extra columns in
    ``keys`` break such a key up.
    """
    out = df
    if keys:
        out = out.repartitionByRange(*keys).sortWithinPartitions(*keys)
    writer = out.write.mode(mode)
    if by:
        writer = writer.partitionBy(*by)
    writer.parquet(path)
    return path


def write_bucketed(
    df: DataFrame, name: str, keys: Sequence[str], buckets: int, path: str | None = None, then: Sequence[str] = (), steps: Sequence[str] = ()
) -> DataFrame:
    """Catalog table bucketed by ``keys``, at ``path`` if given; joins and groups on them skip the shuffle.

    ``df`` should be partitioned by ``keys`` into ``buckets`` already, so that a task writes one file. Files are sorted on ``keys`` and ``then``;
    the columns ``steps`` of whole numbers, sorted for the most part, are written as the steps from one to the next.
    """
    writer = df.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys, *then)
    if steps:
        writer = writer.option("parquet.writer.version", "PARQUET_2_0").options(**{f"parquet.enable.dictionary#{c}": "false" for c in steps})
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


def read_index(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)
