"""Values of many nodes for a whole batch of questions, as arrays, and sums of links or mentions times them.

A state is ``(node, block, mass)`` with an array of ``wide`` values, one for each question of a block. No pair of a question and a
link or mention is a row: the arrays of a block go to all tasks as columns of numbers, and links and mentions are read where they lie, once a block.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.operators.best import Best
from lodeweave.operators.held import held
from lodeweave.session import cut

#: Questions in one array at most, and values of a block that are sent to all tasks.
WIDE, VALUES = 64, 16_000_000


@dataclass
class Batch:
    """The questions of a batch ``(q_id, block, at)``, at place ``at`` of a block's arrays of ``wide`` values, and their number."""

    asked: DataFrame
    n: int
    wide: int

    @property
    def blocks(self) -> int:
        return -(-self.n // self.wide)

    @property
    def columns(self) -> list[str]:
        return [f"m{j}" for j in range(self.wide)]

    def of_block(self, state: DataFrame, block: int) -> DataFrame:
        """The arrays of one block as columns ``(node, m0, ...)``."""
        return state.where(F.col("block") == block).select("node", *[F.col("mass")[j].alias(c) for j, c in enumerate(self.columns)])

    def arrays(self, columns: DataFrame, block: int) -> DataFrame:
        return columns.select("node", F.lit(block).alias("block"), F.array(*self.columns).alias("mass"))


def batch(ids: DataFrame, nodes: int = 0, values: int = VALUES) -> Batch:
    """From questions numbered from 0, ``(q_id, id)``; blocks hold fewer questions where there are many ``nodes``."""
    ids = cut(ids)
    n = ids.count()
    wide = max(1, min(n, WIDE, values // max(nodes, 1)))
    return Batch(cut(ids.select("q_id", F.floor(F.col("id") / wide).cast("int").alias("block"), (F.col("id") % wide).cast("int").alias("at"))), n, wide)


def _lists(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))


def dense(rows: DataFrame, questions: Batch) -> DataFrame:
    """``(node, block, mass)`` of rows ``(q_id, node, mass)``; a question without a row has zero, equal rows are added up."""
    lists = rows.join(questions.asked, "q_id").groupBy("node", "block").agg(F.collect_list(F.struct("at", "mass")).alias("xs"))
    wide = questions.wide

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xs = b["xs"]
            row = np.repeat(np.arange(len(b)), xs.value_lengths().to_numpy())
            values = xs.flatten()
            at, mass = (values.field(i).to_numpy() for i in range(2))
            m = np.bincount(row * wide + at, mass, len(b) * wide).reshape(-1, wide)
            yield pa.RecordBatch.from_arrays([b["node"], b["block"], _lists(m)], ["node", "block", "mass"])

    return lists.mapInArrow(fill, f"node {dict(rows.dtypes)['node']}, block int, mass array<double>")


def rows_of(state: DataFrame, questions: Batch) -> DataFrame:
    """``(q_id, node, mass)`` of the masses above zero."""
    each = state.select("node", "block", F.posexplode("mass").alias("at", "mass")).where("mass > 0")
    return each.join(held(questions.asked), ["block", "at"]).select("q_id", "node", "mass")


def summed(links: DataFrame, key: str, at: str, state: DataFrame, questions: Batch) -> DataFrame:
    """``(key, m0, ...)``: for each ``key`` the sums of ``weight`` times the columns of the nodes ``at`` its links or mentions. These stay in their place if
    they are bucketed by ``key`` and the state may be sent to all tasks."""
    met = links.join(state.withColumnRenamed("node", at), at)
    return met.groupBy(key).agg(*[F.sum(F.col("weight") * F.col(c)).alias(c) for c in questions.columns])


def best_chunks(states: DataFrame | Sequence[DataFrame], questions: Batch, mentions: DataFrame, k: int, rows: int = 10_000) -> DataFrame:
    """``(q_id, chunk_id, score)``: for each question the best ``k`` chunks of every ``rows`` chunks or so, and so the best of all, by the
    sum of mass times weight over the ``mentions`` ``(node, chunk_id, weight)`` of a chunk, if above zero.

    ``states`` is a state or, for each block, its columns. Chunks are scored where their mentions lie, if these are bucketed by chunk.
    """
    kind, found = dict(mentions.dtypes)["chunk_id"], []
    for block in range(questions.blocks):
        state = questions.of_block(states, block) if isinstance(states, DataFrame) else states[block]
        scores = summed(mentions, "chunk_id", "node", held(state), questions)
        best = scores.mapInArrow(_best_rows(questions.columns, k, rows), f"at int, chunk_id {kind}, score double")
        # One block after the other, so that only the columns of one are held.
        found.append(cut(best.withColumn("block", F.lit(block))))
    if not found:
        return mentions.join(questions.asked, F.lit(False)).select("q_id", "chunk_id", F.col("weight").cast("double").alias("score"))
    return functools.reduce(DataFrame.unionByName, found).join(questions.asked, ["block", "at"]).select("q_id", "chunk_id", "score")


def _best_rows(columns: Sequence[str], k: int, rows: int):
    def best_of(chunks: pa.Table) -> pa.RecordBatch:
        # Places of chunks in the order of their ids, which decides ties.
        chunks = chunks.take(pc.sort_indices(chunks["chunk_id"]))
        best = Best(len(columns), min(k, len(chunks)))
        s = np.stack([chunks[c].to_numpy() for c in columns])
        best.offer(np.arange(len(columns)), np.arange(len(chunks)), np.where(s > 0, s, -np.inf))
        r, j = np.nonzero(best.score > -np.inf)
        names = chunks["chunk_id"].combine_chunks().take(pa.array(best.at[r, j]))
        return pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), names, pa.array(best.score[r, j])], ["at", "chunk_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0
        for batch in batches:
            waiting.append(batch)
            n += len(batch)
            if n >= rows:
                yield best_of(pa.Table.from_batches(waiting))
                waiting, n = [], 0
        if n:
            yield best_of(pa.Table.from_batches(waiting))

    return run
