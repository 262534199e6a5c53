"""Joins against keys that may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key with more rows than this is split over several tasks.
ROWS_PER_TASK = 1_000_000


def hot_keys(counts: DataFrame, key: str, n: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``(key, fan)`` of the keys over ``rows_per_task`` rows, from a table of counts.

    There are at most total/rows_per_task of them; Spark broadcasts them where their size allows.
    """
    return counts.where(F.col(n) > rows_per_task).select(
        key, F.ceil(F.col(n) / F.lit(rows_per_task)).cast("int").alias("fan")
    )


def add_salt(big: DataFrame, hot: DataFrame, key: str, by: Column) -> DataFrame:
    """Give each row of a hot key one of ``fan`` salts; other rows get salt 0."""
    return (
        big.join(hot, key, "left")
        .withColumn("salt", F.coalesce(F.pmod(by, F.col("fan")).cast("int"), F.lit(0)))
        .drop("fan")
    )


def copy_per_salt(small: DataFrame, hot: DataFrame, key: str) -> DataFrame:
    """Repeat each row of a hot key once per salt, so that it meets every part."""
    return (
        small.join(hot, key, "left")
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("fan"), F.lit(1)) - 1)))
        .drop("fan")
    )


def salted_join(big: DataFrame, small: DataFrame, key: str, hot: DataFrame, by: Column) -> DataFrame:
    """Inner join on ``key`` in which no task gets the whole of a hot key."""
    return add_salt(big, hot, key, by).join(copy_per_salt(small, hot, key), [key, "salt"]).drop("salt")
