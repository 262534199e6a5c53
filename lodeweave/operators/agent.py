"""Agent steps as work on tables of questions and turns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodeweave.functions import text as tx
from lodeweave.operators.ordered import running_sum
from lodeweave.operators.retrieve import bm25, question_terms
from lodeweave.session import cut


def route(questions: DataFrame, vocabulary: DataFrame, entities: DataFrame, min_entities: int = 2, long: int = 30) -> DataFrame:
    """``(q_id, n_terms, n_known, n_entities, route)``.

    Enough entities go to the graph (``local``), long questions without them to the
    community reports (``global``), questions with known terms to ``text``, the rest
    to ``vector``. ``vocabulary`` has ``term``, ``entities`` has ``entity``.
    """
    asked = question_terms(questions)
    known = vocabulary.select("term").distinct().withColumn("known", F.lit(1))
    names = entities.select(F.col("entity").alias("term")).distinct().withColumn("named", F.lit(1))
    features = (
        asked.join(known, "term", "left")
        .join(names, "term", "left")
        .groupBy("q_id")
        .agg(
            F.count("*").alias("n_terms"),
            F.sum(F.coalesce("known", F.lit(0))).alias("n_known"),
            F.sum(F.coalesce("named", F.lit(0))).alias("n_entities"),
        )
    )
    choice = (
        F.when(F.col("n_entities") >= min_entities, "local")
        .when(F.col("n_terms") >= long, "global")
        .when(F.col("n_known") > 0, "text")
        .otherwise("vector")
    )
    zero = F.lit(0).cast("bigint")
    return (
        questions.select("q_id")
        .join(features, "q_id", "left")
        .select("q_id", *[F.coalesce(c, zero).alias(c) for c in ("n_terms", "n_known", "n_entities")])
        .withColumn("route", choice)
    )


def decompose(questions: DataFrame) -> DataFrame:
    """``(q_id, part, sub_id, text)``: one row per sentence or clause of a question."""
    return (
        questions.select("q_id", F.posexplode(F.split("text", r"[.?!;\n]+")).alias("part", "raw"))
        .select("q_id", "part", tx.squeeze("raw").alias("text"))
        .where("text <> ''")
        .select("q_id", "part", F.concat_ws(".", F.col("q_id").cast("string"), F.col("part").cast("string")).alias("sub_id"), "text")
    )


def iterate(
    questions: DataFrame,
    post: DataFrame,
    stats: DataFrame,
    rounds: int = 2,
    k: int = 5,
    n_new: int = 3,
    rarity: DataFrame | None = None,
) -> DataFrame:
    """``(q_id, round, chunk_id, score, rank)``: retrieval in rounds with feedback.

    After each round a question gains the ``n_new`` terms that its hits hold most
    often and that it lacks (rarer terms first on ties, then by name); chunks
    it has seen are dropped. The loop ends early when no question finds a new chunk.
    """
    asked = cut(question_terms(questions))
    out = None
    for r in range(1, rounds + 1):
        hits = bm25(asked, post, stats, k * r, rarity=rarity)
        if out is not None:
            hits = hits.join(out.select("q_id", "chunk_id"), ["q_id", "chunk_id"], "left_anti")
        order = W.partitionBy("q_id").orderBy("rank")
        fresh = cut(
            hits.withColumn("place", F.row_number().over(order))
            .where(F.col("place") <= k)
            .select("q_id", F.lit(r).alias("round"), "chunk_id", "score", F.col("place").alias("rank"))
        )
        if fresh.isEmpty():
            break
        out = fresh if out is None else out.unionByName(fresh)
        if r == rounds:
            break
        held = (
            post.join(fresh.select("q_id", "chunk_id"), "chunk_id")
            .groupBy("q_id", "term")
            .agg(F.count("*").alias("chunks"), F.sum("tf").alias("tf"))
            .join(asked, ["q_id", "term"], "left_anti")
        )
        best = W.partitionBy("q_id").orderBy(F.col("chunks").desc(), F.col("tf"), "term")
        new = held.withColumn("r", F.row_number().over(best)).where(F.col("r") <= n_new).select("q_id", "term")
        asked = cut(asked.unionByName(new))
    return out


def memory(turns: DataFrame, budget: int) -> DataFrame:
    """``(conv_id, turn, role, n_pieces, used)``: the newest turns within ``budget`` pieces;
    system turns are always kept and cost nothing."""
    sized = turns.withColumn("n_pieces", F.size(tx.pieces("text")))
    cost = F.when(F.col("role") == "system", 0).otherwise(F.col("n_pieces")).cast("bigint")
    summed = running_sum(sized, "conv_id", "turn", cost, "used", newest_first=True)
    return summed.where((F.col("role") == "system") | (F.col("used") <= budget)).select(
        "conv_id", "turn", "role", "n_pieces", "used"
    )


def contextualize(turns: DataFrame, n: int = 2) -> DataFrame:
    """``(conv_id, turn, text, context)``: each user turn with the terms of the ``n`` turns
    before it that it lacks, in alphabetical order.

    Every turn is sent to the ``n`` turn numbers after it, so the join key is
    (conversation, turn) and no conversation is gathered.
    """
    later = (
        turns.select("conv_id", "turn", tx.terms("text").alias("t"))
        .select("conv_id", F.explode(F.sequence(F.col("turn") + 1, F.col("turn") + n)).alias("turn"), "t")
        .groupBy("conv_id", "turn")
        .agg(F.flatten(F.collect_list("t")).alias("before"))
    )
    user = turns.where("role = 'user'")
    extra = F.array_sort(F.array_except("before", tx.terms("text")))
    return user.join(later, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "text", F.coalesce(F.array_join(extra, " "), F.lit("")).alias("context")
    )


def trace(steps: Mapping[str, DataFrame], routes: DataFrame | None = None) -> DataFrame:
    """``(q_id, round, step, route, n_hits, best, gain)``: one row per question, round and step with hits.

    ``steps`` are named hit lists in the order they ran; one without a ``round`` column is round 1. ``gain`` counts
    the chunks that no earlier round of the question, and no earlier step of the same round, had found.
    ``routes`` are ``(q_id, route)``; the route of a question without one is null.
    """
    rows = None
    for no, (name, hits) in enumerate(steps.items()):
        turn = F.col("round") if "round" in hits.columns else F.lit(1)
        one = hits.select("q_id", turn.cast("int").alias("round"), F.lit(no).alias("no"), F.lit(name).alias("step"), "chunk_id", "score")
        rows = one if rows is None else rows.unionByName(one)
    found = W.partitionBy("q_id", "chunk_id").orderBy("round", "no")
    out = (
        rows.withColumn("new", (F.row_number().over(found) == 1).cast("bigint"))
        .groupBy("q_id", "round", "step")
        .agg(F.count("*").alias("n_hits"), F.max("score").alias("best"), F.sum("new").alias("gain"))
    )
    if routes is None:
        return out.withColumn("route", F.lit(None).cast("string"))
    return out.join(routes.select("q_id", "route"), "q_id", "left")


def log_trace(steps: DataFrame, path: str, run: int) -> DataFrame:
    """Append a trace to the log at ``path`` and read the log back, with ``run``. A run logged again replaces its
    own rows only."""
    steps.write.mode("overwrite").parquet(f"{path}/run={run}")
    schema = steps.withColumn("run", F.lit(run).cast("bigint")).schema
    return steps.sparkSession.read.schema(schema).parquet(path)
