"""Contiguous shards of near equal bytes from global prefix sums.

Rows are ranged by (text, id). Each partition adds up its own bytes and rows, the totals of the partitions
give every partition its offset, and the corpus is cut at equal shares of the global sum. Copies of a
text are neighbours in that order; a cut that would split them moves to their edge when that is at most
``SLACK`` of a shard away, and splits them otherwise, so shards stay equal however many copies there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeweave.llm.common import partitions, table

SHARDS = 8
SLACK = 0.005
_RANGED = "doc_id long, size long, text_crc32 long, h string, pid int, b long, r long"


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes and rows before each row of its partition."""
    pid, b, r = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        size = batch.column("size").to_numpy()
        ends = b + np.cumsum(size)
        n = len(size)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, pid, np.int32)), pa.array(ends - size), pa.array(np.arange(r, r + n))], names=[*batch.schema.names, "pid", "b", "r"])
        if n:
            b, r = int(ends[-1]), r + n


def _cuts(placed: DataFrame, total: int, shards: int) -> list[int]:
    """Bytes at which the shards from the second on begin."""
    goal = [total * k / shards for k in range(1, shards)]
    hit = F.array(*[(F.col("b") < g) & (F.col("b") + F.col("size") >= g) for g in goal])
    rows = placed.where(F.exists(hit, lambda x: x)).select("h", "b", "size").collect()  # at most one row a cut
    groups = placed.where(F.col("h").isin([r["h"] for r in rows])).groupBy("h").agg(F.min("b").alias("a"), F.max(F.col("b") + F.col("size")).alias("z")).collect()
    edge = {g["h"]: (g["a"], g["z"]) for g in groups}
    cuts = []
    for g in goal:
        row = next(r for r in rows if r["b"] < g <= r["b"] + r["size"])
        near = min(edge[row["h"]], key=lambda x: abs(x - g))
        own = min((row["b"], row["b"] + row["size"]), key=lambda x: abs(x - g))
        cuts.append(near if abs(near - g) <= SLACK * total / shards else own)
    return cuts


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` of every row, by the law ``bytes``.

    ``size`` is the text's bytes plus one, a null text has none and the checksum 0. ``slot`` counts a shard's rows
    from 0 in the global order. Repeated rows keep a slot each, null ids come first among copies, and a shard may be
    empty if there are fewer rows than shards. Other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("h")
    )
    n = partitions(docs.sparkSession)
    ranged = table(rows.repartitionByRange(n, "h", "doc_id").sortWithinPartitions("h", "doc_id").mapInArrow(_running, _RANGED), "ranged")
    totals = ranged.groupBy("pid").agg(F.max(F.col("b") + F.col("size")).alias("bytes"), F.count("*").alias("rows"))
    before = W.orderBy("pid").rowsBetween(W.unboundedPreceding, -1)
    offsets = table(totals.select("pid", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("b0"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("r0"), "bytes"), "offsets")
    placed = ranged.join(offsets.drop("bytes"), "pid").select("doc_id", "size", "text_crc32", "h", (F.col("b") + F.col("b0")).alias("b"), (F.col("r") + F.col("r0")).alias("r"))
    total = offsets.agg(F.sum("bytes")).first()[0]
    number = F.lit(0)
    if total:
        for cut in _cuts(placed, total, shards):
            number = number + (F.col("b") >= cut).cast("int")
    numbered = placed.withColumn("shard", number.cast("int"))
    first = {r["shard"]: r["r"] for r in numbered.groupBy("shard").agg(F.min("r").alias("r")).collect()}  # one row a shard
    starts = F.element_at(F.array(*[F.lit(first.get(k, 0)).cast("long") for k in range(shards)]), F.col("shard") + 1)
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("r") - starts).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
