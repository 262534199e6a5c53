"""Ordered work on keys that may be large, in blocks of the order column.

A plain window would sort a whole key in one task. Here each (key, block) is a group
of its own, and only one summary row per block is ordered across the key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def running_sum(df: DataFrame, key: str, order: str, value: Column, out: str, block: int = 256, newest_first: bool = False) -> DataFrame:
    """Add the sum of ``value`` up to and including each row, by an integer ``order`` column."""
    rows = df.withColumn("_v", value).withColumn("_b", F.floor(F.col(order) / F.lit(block)))
    near = F.col(order).desc() if newest_first else F.col(order)
    far = F.col("_b").desc() if newest_first else F.col("_b")
    inside = F.sum("_v").over(W.partitionBy(key, "_b").orderBy(near).rowsBetween(W.unboundedPreceding, 0))
    before = F.sum("_t").over(W.partitionBy(key).orderBy(far).rowsBetween(W.unboundedPreceding, -1))
    totals = rows.groupBy(key, "_b").agg(F.sum("_v").alias("_t")).withColumn("_before", F.coalesce(before, F.lit(0)))
    return (
        rows.withColumn("_in", inside)
        .join(totals.drop("_t"), [key, "_b"])
        .withColumn(out, F.col("_in") + F.col("_before"))
        .drop("_v", "_b", "_in", "_before")
    )


def as_of(
    questions: DataFrame,
    facts: DataFrame,
    key: str,
    ts: str = "ts",
    values: Sequence[str] = (),
    block_seconds: int = 86400,
) -> DataFrame:
    """Each question row with the latest fact of its key at or before its time.

    ``values`` are the fact's columns to attach, with ties on time going to the greatest values in
    the given order; ``fact_ts`` is its time. Questions without an earlier fact keep nulls.
    """
    block = F.floor(F.unix_timestamp(ts) / F.lit(block_seconds))
    fact = F.struct(F.col(ts).alias("fact_ts"), *[F.col(v).alias(v) for v in values])
    own = [c for c in questions.columns]
    q = questions.select(key, ts, block.alias("_b"), F.lit(1).alias("_q"), F.struct(*own).alias("_row"))
    f = facts.select(key, ts, block.alias("_b"), F.lit(0).alias("_q"), fact.alias("_fact"))
    rows = q.unionByName(f, allowMissingColumns=True)
    # Within a block, facts come before questions of the same time.
    seen = F.max("_fact").over(W.partitionBy(key, "_b").orderBy(ts, "_q").rowsBetween(W.unboundedPreceding, 0))
    earlier = F.max("_last").over(W.partitionBy(key).orderBy("_b").rowsBetween(W.unboundedPreceding, -1))
    carried = rows.groupBy(key, "_b").agg(F.max("_fact").alias("_last")).select(key, "_b", earlier.alias("_carried"))
    found = (
        rows.withColumn("_seen", seen)
        .where("_q = 1")
        .join(carried, [key, "_b"])
        .withColumn("_hit", F.coalesce("_seen", "_carried"))
    )
    return found.select("_row.*", "_hit.fact_ts", *[F.col(f"_hit.{v}").alias(f"fact_{v}") for v in values])
