"""Retrieval metrics. Truth is ``(q_id, doc_id)``; hits carry ``doc_id`` and ``rank``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.functions import text as tx


def passage_truth(questions: DataFrame, docs: DataFrame, n: int = 8) -> DataFrame:
    """``(q_id, doc_id, shared)``: documents that share an ``n``-gram of terms with a question.

    Each document row first drops its repeated n-grams; the question side is
    broadcast by Spark when its size allows.
    """
    asked = questions.select("q_id", F.explode(F.array_distinct(tx.ngrams(tx.terms("text"), n))).alias("g"))
    held = docs.select("doc_id", F.explode(F.array_distinct(tx.ngrams(tx.terms("text"), n))).alias("g"))
    return held.join(asked, "g").groupBy("q_id", "doc_id").agg(F.count("*").alias("shared"))


def doc_hits(hits: DataFrame) -> DataFrame:
    return hits.withColumn("doc_id", F.split("chunk_id", ":")[0].cast("bigint"))


def recall(hits: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """``(q_id, n_true, n_found, recall, precision)`` for questions that have a true document."""
    top = hits.where(F.col("rank") <= k).select("q_id", "doc_id").distinct().withColumn("hit", F.lit(1))
    return (
        truth.select("q_id", "doc_id")
        .join(top, ["q_id", "doc_id"], "left")
        .groupBy("q_id")
        .agg(F.count("*").alias("n_true"), F.sum(F.coalesce("hit", F.lit(0))).alias("n_found"))
        .select(
            "q_id",
            "n_true",
            "n_found",
            (F.col("n_found") / F.col("n_true")).alias("recall"),
            (F.col("n_found") / F.lit(k)).alias("precision"),
        )
    )


def mrr(hits: DataFrame, truth: DataFrame) -> DataFrame:
    """``(q_id, first_rank, rr)``; a question whose true documents are all missed scores 0."""
    found = hits.join(truth.select("q_id", "doc_id"), ["q_id", "doc_id"], "left_semi")
    first = found.groupBy("q_id").agg(F.min("rank").alias("first_rank"))
    return (
        truth.select("q_id")
        .distinct()
        .join(first, "q_id", "left")
        .select("q_id", "first_rank", F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)).alias("rr"))
    )


def ndcg(hits: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """``(q_id, dcg, ideal, ndcg)`` with gain 1 per true document (Järvelin & Kekäläinen 2002)."""
    best = hits.where(F.col("rank") <= k).groupBy("q_id", "doc_id").agg(F.min("rank").alias("rank"))
    gained = (
        best.join(truth.select("q_id", "doc_id"), ["q_id", "doc_id"], "left_semi")
        .groupBy("q_id")
        .agg(F.sum(1.0 / F.log2(F.col("rank") + F.lit(1.0))).alias("dcg"))
    )
    places = F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int"))
    ideal = truth.groupBy("q_id").agg(F.count("*").alias("n")).select(
        "q_id", F.aggregate(places, F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + F.lit(1.0))).alias("ideal")
    )
    return ideal.join(gained, "q_id", "left").select(
        "q_id",
        F.coalesce("dcg", F.lit(0.0)).alias("dcg"),
        "ideal",
        (F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).alias("ndcg"),
    )


def ann_recall(approx: DataFrame, exact: DataFrame, k: int, id_col: str = "id") -> DataFrame:
    """One row ``(n_questions, recall)``: the share of exact neighbours that the approximate search found."""
    got = approx.where(F.col("rank") <= k).select("q_id", id_col).withColumn("hit", F.lit(1.0))
    per = (
        exact.where(F.col("rank") <= k)
        .join(got, ["q_id", id_col], "left")
        .groupBy("q_id")
        .agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("r"))
    )
    return per.agg(F.count("*").alias("n_questions"), F.avg("r").alias("recall"))


def coverage(packed: DataFrame, truth: DataFrame) -> DataFrame:
    """``(q_id, n_true, n_kept, coverage)``: true documents that have a chunk in the packed context."""
    kept = doc_hits(packed).select("q_id", "doc_id").distinct().withColumn("hit", F.lit(1))
    return (
        truth.select("q_id", "doc_id")
        .join(kept, ["q_id", "doc_id"], "left")
        .groupBy("q_id")
        .agg(F.count("*").alias("n_true"), F.sum(F.coalesce("hit", F.lit(0))).alias("n_kept"))
        .withColumn("coverage", F.col("n_kept") / F.col("n_true"))
    )
