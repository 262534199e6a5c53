"""Start a stream over the files at hand and wait for its end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lodeweave.session import new_path


def run_to_table(df: DataFrame, name: str, mode: str = "append") -> tuple[DataFrame, StreamingQuery]:
    """Write a stream to a parquet table (exactly once, by the file sink's log) and read it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    query = (
        df.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", path)
        .option("checkpointLocation", new_path(spark, f"{name}-log"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(path), query


def run_batches(
    df: DataFrame, fn: Callable[[DataFrame, int], None], name: str, mode: str = "append", log: str | None = None
) -> StreamingQuery:
    """Run ``fn`` on each micro-batch. ``log`` names the checkpoint folder of a stream that
    is to be resumed."""
    query = (
        df.writeStream.foreachBatch(fn)
        .outputMode(mode)
        .option("checkpointLocation", log or new_path(df.sparkSession, f"{name}-log"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def late_rows(query: StreamingQuery) -> int:
    """Rows that the query dropped for being older than the watermark."""
    return sum(
        int(op.get("numRowsDroppedByWatermark", 0)) for p in query.recentProgress for op in p["stateOperators"]
    )
