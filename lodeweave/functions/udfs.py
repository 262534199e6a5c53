"""Functions for callers: table function, embedding wrapper, vector mean, SQL registration."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@F.udtf(returnType="chunk_no int, text string")
class ChunkText:
    """SQL table function ``chunk_text(text, size, stride)``; ``corpus.chunk`` is the JVM form."""

    def eval(self, text: str, size: int, stride: int):
        import re

        # Fixed value: the piece pattern of functions.text.pieces, with ASCII blanks.
        p = re.findall(r"[^ \t\n\x0b\f\r]{1,64}", text or "")
        for no in range(max(-(-(len(p) - size) // stride), 0) + 1 if p else 0):
            yield no, " ".join(p[no * stride : no * stride + size])


def embed_udf(fn: Callable[[list[str]], np.ndarray]):
    """Wrap a batch embedding function as a column function over Arrow batches."""

    @F.pandas_udf("array<double>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(list(np.asarray(fn(s.tolist()), dtype=float))) if len(s) else pd.Series([], dtype=object)

    return embed


def vector_mean(df: DataFrame, group: str, col: str = "embedding") -> DataFrame:
    """``(group, mean, n)``: element-wise mean. Sums are partial per (group, position), so a
    group of any size meets as one row per position and task."""
    per = (
        df.select(group, F.posexplode(col).alias("i", "x"))
        .groupBy(group, "i")
        .agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("n"))
    )
    return per.groupBy(group).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("mean"),
        F.max("n").alias("n"),
    )


def register_all(spark: SparkSession) -> None:
    """Make the helpers callable from SQL: ``lw_terms``, ``lw_dot``, ``lw_cosine``, ``lw_rrf``, ``chunk_text``."""
    spark.sql(
        r"CREATE OR REPLACE TEMPORARY FUNCTION lw_terms(s STRING) RETURNS ARRAY<STRING> "
        r"RETURN regexp_extract_all(lower(s), '\\p{L}+', 0)"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION lw_dot(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE "
        "RETURN aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION lw_cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE "
        "RETURN CASE WHEN lw_dot(a, a) = 0 OR lw_dot(b, b) = 0 THEN 0D "
        "ELSE lw_dot(a, b) / (sqrt(lw_dot(a, a)) * sqrt(lw_dot(b, b))) END"
    )
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION lw_rrf(r INT, c INT) RETURNS DOUBLE RETURN 1D / (c + r)")
    spark.udtf.register("chunk_text", ChunkText)
