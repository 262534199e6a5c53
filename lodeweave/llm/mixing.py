"""Mixing sources to target weights by Pareto order sampling (Rosen 1997).

A source's target is met with whole copies of all its documents as far as they go. What is left is drawn
without replacement: a document gets inclusion probability p, proportional to its desirability (here the
bits of its length, so longer documents are likelier), and rank

    (u / (1 - u)) / (p / (1 - p)),    u uniform from its id,

and documents are taken in order of rank until the words are reached. A document with p = 1 comes first.

No source is sorted as a whole. Ranks are counted in ``CELLS`` cells per source, running sums
over the cells give the cell in which the target falls, and only that cell's rows are sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeweave.llm.common import table, words

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
CELLS = 65_536


def sized(docs: DataFrame, *keep) -> DataFrame:
    """``keep``, and ``_m_key`` (source), ``_m_size`` in words and ``_m_u``, uniform in (0, 1)."""
    size = F.size(words(F.col("text").cast("string"))).cast("long")
    source = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null"))
    step = docs.select(*keep, F.col("doc_id").alias("_m_id"), F.col("source").cast("string").alias("_m_source"), source.alias("_m_key"), size.alias("_m_size"))
    digits = F.substring(F.md5(F.concat(F.coalesce(F.col("_m_id").cast("string"), F.lit("")), F.lit(":"), F.col("_m_size").cast("string"))), 1, 12)
    u = (F.conv(digits, 16, 10).cast("long") + 0.5) / float(1 << 48)
    return step.withColumn("_m_u", u)


def _bits():
    return F.length(F.bin("_m_size")).cast("long")


def targets(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """``(_s_key, source_size, target, copies, rest, pull)``: per source the words it has and is to give,
    whole copies of all its documents, words left to draw, and the factor that turns bits into probability.

    ``share`` of all words goes to the sources by weight. Targets stop at ``cap`` times the source; with
    sources in order of cap over weight, the level that shares out the rest is the first that its
    successors can take.
    """
    sums = rows.groupBy("_m_key").agg(F.first("_m_source").alias("source"), F.sum("_m_size").alias("s"), F.sum(F.col("_m_size") * _bits()).alias("sb"))
    # One row a source from here on.
    named = sums.withColumn("k", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("k") % len(weights) + 1).cast("int"))
    sized_up = table(named.withColumn("w", weight).withColumn("most", cap * F.col("s")), "sources")
    order = W.orderBy(F.col("most") / F.col("w"), "k")
    levels = sized_up.select(
        "*",
        (share * F.sum("s").over(W.partitionBy())).alias("all"),
        F.coalesce(F.sum("most").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("full"),
        F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing)).alias("left"),
    ).withColumn("level", (F.col("all") - F.col("full")) / F.col("left"))
    level = levels.agg(F.max(F.when(F.col("level") * F.col("w") <= F.col("most"), F.col("level"))).alias("level"))
    met = sized_up.join(F.broadcast(level))  # one row
    target = F.least(F.col("most").cast("double"), F.coalesce(F.col("level") * F.col("w"), F.col("most").cast("double")))
    met = met.withColumn("target", target).withColumn("copies", F.when(F.col("s") > 0, F.floor(F.col("target") / F.col("s"))).otherwise(0).cast("int"))
    met = met.withColumn("rest", F.col("target") - F.col("copies") * F.col("s"))
    pull = F.when(F.col("sb") > 0, F.col("rest") / F.col("sb")).otherwise(0.0)
    return met.select(F.col("_m_key").alias("_s_key"), F.col("s").alias("source_size"), "target", "copies", "rest", pull.alias("pull"))


def drawn(rows: DataFrame) -> DataFrame:
    """``rows`` of ``sized`` with the columns of ``targets`` as ``_s_<name>`` and ``_m_copies``, how often each is taken."""
    goals = targets(rows)
    goals = table(goals.select("_s_key", *[F.col(c).alias(f"_s_{c}") for c in goals.columns if c != "_s_key"]), "targets")
    met = rows.join(goals, F.col("_m_key") == F.col("_s_key"))
    p = F.least(F.lit(1.0), F.col("_s_pull") * _bits())
    odds = F.col("_m_u") / (1 - F.col("_m_u"))
    rank = F.when(p >= 1, 0.0).when(p <= 0, F.lit(float("inf"))).otherwise(odds / (p / (1 - p)))
    met = met.withColumn("_m_rank", rank).withColumn("_m_cell", F.when(F.col("_m_rank") == float("inf"), CELLS - 1).otherwise(F.floor(CELLS * F.col("_m_rank") / (1 + F.col("_m_rank")))).cast("int"))
    cells = met.groupBy("_m_key", "_m_cell", "_s_rest").agg(F.sum("_m_size").alias("n"))
    upto = cells.withColumn("upto", F.sum("n").over(W.partitionBy("_m_key").orderBy("_m_cell")))
    # The first cell at whose end the rest is reached; none if all of the source is too little, or if there is no rest:
    # then all ranks are infinite, and one cell would hold the whole source.
    ends = upto.where((F.col("_s_rest") > 0) & (F.col("upto") >= F.col("_s_rest"))).groupBy("_m_key").agg(F.min(F.struct("_m_cell", (F.col("upto") - F.col("n")).alias("before"))).alias("e"))
    ends = table(ends.select(F.col("_m_key").alias("_e_key"), F.col("e._m_cell").alias("_e_cell"), F.col("e.before").alias("_e_before")), "cells")
    found = met.join(ends, F.col("_m_key") == F.col("_e_key"), "left")
    plain = found.where(F.col("_e_cell").isNull() | (F.col("_m_cell") != F.col("_e_cell")))
    plain = plain.withColumn("_m_more", ((F.col("_s_rest") > 0) & (F.col("_e_cell").isNull() | (F.col("_m_cell") < F.col("_e_cell")))).cast("int"))
    order = W.partitionBy("_m_key").orderBy("_m_rank", "_m_id", "_m_size").rowsBetween(W.unboundedPreceding, -1)
    last = found.where(F.col("_m_cell") == F.col("_e_cell")).withColumn("_m_so_far", F.col("_e_before") + F.coalesce(F.sum("_m_size").over(order), F.lit(0)))
    # The document in which the rest is reached is taken if more than half of it fits.
    last = last.withColumn("_m_more", (2 * F.col("_m_so_far") + F.col("_m_size") <= 2 * F.col("_s_rest")).cast("int")).drop("_m_so_far")
    return plain.unionByName(last).withColumn("_m_copies", F.col("_s_copies") + F.col("_m_more"))


def mix(docs: DataFrame) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` of every row; ``taken`` counts its words as often as the mix
    takes it, twice at most.

    Null texts have size 0; a null source is a source. Rows with one id and size share their rank, and are
    taken in any order among themselves. Other columns are ignored.
    """
    rows = table(sized(docs, F.col("doc_id").cast("long").alias("doc_id")), "sizes")
    return drawn(rows).select("doc_id", F.col("_m_size").alias("size"), F.col("_s_source_size").alias("source_size"), F.col("_s_target").alias("target"), (F.col("_m_copies") * F.col("_m_size")).alias("taken"))


def take(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with their columns."""
    own = [F.col(f"`{c}`") for c in docs.columns]
    rows = table(sized(docs, *own), "sizes")
    met = drawn(rows)
    return met.where("_m_copies > 0").withColumn("_m_nth", F.explode(F.array_repeat(F.lit(1), F.col("_m_copies")))).select(*own)
