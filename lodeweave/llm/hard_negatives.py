"""Hard negatives by Fagin's threshold algorithm.

The rows are dealt by hash into blocks of about ``BLOCK_ROWS``. A block keeps, for each dimension, its rows
in the order of that component. For an anchor all lists are read in step, from the largest component down
where the anchor's component is positive and from the smallest up where it is negative; the rows met are
scored in full (random access), in integers. No row unmet can score more than the threshold: the anchor's
product with the components at the places reached. A block is left when the threshold is strictly below
the kth score of every window of the anchor, or below the window itself; strictly, as a row of equal score
may have the smaller id. The best rows of all blocks are ranked together.

Two searches follow each other: the positives (best rows of the anchor's label), then the negatives, with one
window a positive. Anchors grow with the table, so they are dealt into chunks: a task gets one block and
one chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 5
BLOCK_ROWS = 8192
CHUNK_ANCHORS = 1024
# Places read in each list before the first look at the threshold; doubled from look to look.
FIRST_DEPTH = 32
# Whole numbers up to here are exact as doubles.
EXACT = 2**53
LONG = 2**63 - 1
LOW, HIGH = 80, 100  # a window in hundredths of the positive score


def _whole(v: Column) -> Column:
    return F.transform(v, lambda x: F.floor(x.cast("double") * 256))


def usable(vectors: DataFrame) -> DataFrame:
    """``(vec_id, label, v)`` of the rows that take part: no null id or label, no null vector or component, all
    components finite. ``v`` holds floor(256 x); ids divisible by 7 have the next label modulo 10."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    vec_id, label = F.col("vec_id").cast("long"), F.col("label").cast("long")
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False)))
    return rows.select(vec_id.alias("vec_id"), F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), _whole(F.col("embedding")).alias("v"))


@dataclass
class Block:
    """Rows of one length, with the order of each dimension."""

    ids: np.ndarray
    labels: np.ndarray
    v: np.ndarray
    up: np.ndarray

    @classmethod
    def of(cls, rows: pa.Table) -> Block:
        ids, labels = rows.column("vec_id").to_numpy(), rows.column("label").to_numpy()
        v = _matrix(rows.column("v"), len(ids))
        # A repeated id stands once, with its least label and vector.
        order = np.lexsort((*v.T[::-1], labels, ids))
        order = order[np.concatenate(([True], ids[order][1:] != ids[order][:-1]))]
        ids, labels, v = ids[order], labels[order], v[order]
        return cls(ids, labels, v, np.argsort(v, axis=0, kind="stable").astype(np.int32))

    def walk(self, anchor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(rows met for the first time, their scores, threshold of the rows not met yet) look by look."""
        n = len(self.ids)
        dims = np.flatnonzero(anchor)
        a = anchor[dims]
        high = int(np.abs(anchor).max(initial=0)) * int(max(abs(int(self.v.max(initial=0))), abs(int(self.v.min(initial=0))))) * max(len(anchor), 1)
        a, v = (a.astype(float), self.v.astype(float)) if high < EXACT else (a.astype(object), self.v.astype(object))
        v = v[:, dims]
        positive = anchor[dims] > 0
        unmet = np.ones(n, bool)

        def at(start: int, end: int) -> np.ndarray:
            down = self.up[n - end : n - start, dims][::-1]
            return np.where(positive, down, self.up[start:end, dims])

        def bound(place: int) -> int:
            return _within(np.dot(v[at(place, place + 1)[0], np.arange(len(dims))], a)) if len(dims) else 0

        yield np.zeros(0, np.int64), np.zeros(0, np.int64), bound(0)
        start, end = 0, min(FIRST_DEPTH, n)
        while True:
            met = np.zeros(n, bool)
            if len(dims):
                met[at(start, end).ravel()] = True
            else:
                met[:] = True  # all scores are zero
            new = np.flatnonzero(met & unmet)
            unmet[new] = False
            scores = v[new] @ a
            scores = scores.astype(np.int64) if high < EXACT else np.array([_within(s) for s in scores], object)
            if not unmet.any():
                yield new, scores, None
                return
            yield new, scores, bound(end - 1)
            start, end = end, min(2 * end, n)


def _within(score) -> int:
    return max(-LONG, min(LONG, int(score)))


def _matrix(lists: pa.ChunkedArray, n: int) -> np.ndarray:
    flat = lists.combine_chunks()
    flat = flat.flatten() if not isinstance(flat, pa.ChunkedArray) else pa.concat_arrays([c.flatten() for c in flat.chunks])
    return flat.to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, -1)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def search(block: Block, anchor: np.ndarray, allowed: np.ndarray, windows: list[tuple[int, int] | None], k: int = K) -> list[tuple[np.ndarray, np.ndarray]]:
    """The first ``k`` allowed rows of each window ``(least, most)`` in hundredths of a score; None is the window of
    all scores. For each window: ids and scores, best first."""
    found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in windows]
    open_ = set(range(len(windows)))
    for new, scores, threshold in block.walk(anchor):
        keep = allowed[new]
        new, scores = new[keep], scores[keep]
        for w in list(open_):
            window = windows[w]
            inside = np.ones(len(new), bool) if window is None else np.array((100 * scores >= window[0]) & (100 * scores <= window[1]), bool)
            if inside.any():
                ids = np.concatenate((found[w][0], block.ids[new[inside]]))
                all_scores = np.concatenate((found[w][1], scores[inside]))
                best = _best(ids, all_scores, k)
                found[w] = ids[best], all_scores[best]
            if threshold is not None:
                full = len(found[w][0]) == k and threshold < found[w][1][-1]
                if full or (window is not None and 100 * threshold < window[0]):
                    open_.discard(w)
        if not open_:
            break
    return found


def _positives(rows: pa.Table, anchors: pa.Table) -> pa.Table:
    out: list[list] = [[], [], []]
    if rows.num_rows and anchors.num_rows:
        block = Block.of(rows)
        for anchor_id, label, v in zip(anchors.column("vec_id").to_pylist(), anchors.column("label").to_pylist(), _matrix(anchors.column("v"), anchors.num_rows)):
            ((ids, scores),) = search(block, v, (block.labels == label) & (block.ids != anchor_id), [None])
            out[0] += [anchor_id] * len(ids)
            out[1] += ids.tolist()
            out[2] += scores.tolist()
    return pa.table([pa.array(c, pa.int64()) for c in out], ["anchor_id", "positive_id", "positive_score"])


def _negatives(rows: pa.Table, anchors: pa.Table) -> pa.Table:
    out: list[list] = [[], [], [], [], []]
    if rows.num_rows and anchors.num_rows:
        block = Block.of(rows)
        for anchor_id, label, v, positives in zip(
            anchors.column("vec_id").to_pylist(), anchors.column("label").to_pylist(), _matrix(anchors.column("v"), anchors.num_rows), anchors.column("positives").to_pylist()
        ):
            windows = [(LOW * p["positive_score"], HIGH * p["positive_score"]) for p in positives]
            for p, (ids, scores) in zip(positives, search(block, v, block.labels != label, windows)):
                out[0] += [anchor_id] * len(ids)
                out[1] += [p["positive_id"]] * len(ids)
                out[2] += ids.tolist()
                out[3] += [p["positive_score"]] * len(ids)
                out[4] += scores.tolist()
    return pa.table([pa.array(c, pa.int64()) for c in out], ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])


def _meet(rows: DataFrame, anchors: DataFrame, blocks: int, chunks: int, find: Callable, schema: str) -> DataFrame:
    """Every block of rows with every chunk of anchors whose vectors have the same length."""
    n = F.size("v").alias("dims")
    key = F.xxhash64("vec_id")
    dealt = rows.select("*", n, F.pmod(key, F.lit(blocks).cast("long")).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    own = [F.col(c).alias(c) for c in anchors.columns]  # both sides come from one table
    asked = anchors.select(*own, n, F.pmod(key, F.lit(chunks)).cast("int").alias("chunk"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    keys = ["dims", "block", "chunk"]
    return dealt.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(find, schema)


def mine(vectors: DataFrame, anchor_step: int = 100) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` of the rows of ``(vec_id,
    embedding, label)``; other columns are not read.

    Anchors are the rows whose id is divisible by ``anchor_step``. Rows of an id that stands more than once count
    once, with the least label and vector. Vectors of another length than the anchor's are neither positive nor
    negative. Ties go to the smaller id. A positive score below zero leaves no window, so no rows. Components
    and scores beyond 64 bits count as the largest 64-bit number. An empty table has no rows.
    """
    rows = usable(vectors)
    n, asked = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % anchor_step == 0)).first()
    blocks, chunks = max(1, -(-n // BLOCK_ROWS)), max(1, -(-asked // CHUNK_ANCHORS))
    anchors = rows.where(F.col("vec_id") % anchor_step == 0).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")
    near = _meet(rows, anchors, blocks, chunks, _positives, "anchor_id long, positive_id long, positive_score long")
    first = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    near = near.withColumn("place", F.row_number().over(first)).where(F.col("place") <= K)
    windows = near.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_list(F.struct("positive_score", "positive_id"))).alias("positives"))
    asking = anchors.join(windows, "vec_id").select("vec_id", "label", "v", "positives")
    far = _meet(rows, asking, blocks, chunks, _negatives, "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    best = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return far.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= K).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
