"""Approximate nearest neighbours with balanced posting lists, after SPANN (Chen et al. 2021).

Centroids are fitted on a bounded sample by halving it at the median of its widest direction until the leaves
are small, so they stand for equal numbers of vectors. The centroids and a neighbour graph among them are small
(``MAX_LISTS``) and in memory of every task; whoever looks for near centroids walks that graph. Every vector
goes to its nearest list, and to further ones that are nearly as near (``CLOSURE``), so a query that comes from
the other side of a boundary still meets it. A query reads the lists within a multiple of the distance of
its nearest one: at least ``REACH``, and as much more as recall takes. That is measured on up to ``TRIED`` of the queries, whose
nearest vectors are found by brute force, at the lists that the table really has; if no multiple does, all lists are read. Lists are dealt out in chunks of ``CHUNK`` rows, so a list with a third of all vectors is many
tasks, and equal query vectors are searched once. Scores are exact cosines of the original vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeweave.llm.common import sample, table

SAMPLE = 20_000
MAX_LISTS = 4096
LIST_ROWS = 400
CHUNK = 20_000
COPIES = 2
CLOSURE = 1.02
REACH = 1.12
# Recall that the tried queries must reach; above 0.9, as they are a sample.
AIM = 0.95
TRIED = 200
K = 5
# Pairs of row and list that a walk holds at once, about.
WALK = 400_000
DEGREE = 24


def usable(rows: DataFrame) -> DataFrame:
    """``(vec_id, v)`` with ``v`` as array of doubles; vectors that are null or zero or hold a null, NaN or
    infinite component are left out, as are null ids and repeated rows of an id and vector."""
    v = F.col("embedding").cast("array<double>")
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.coalesce(fine, F.lit(False)))


def _unit(x: np.ndarray) -> np.ndarray:
    # Scaled first, so that neither huge nor tiny components lose the length.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _leaves(x: np.ndarray, most: int, rng: np.random.Generator) -> list[np.ndarray]:
    out, todo = [], [x]
    while todo:
        part = todo.pop()
        if len(part) <= most:
            out.append(part.mean(axis=0))
            continue
        centred = part - part.mean(axis=0)
        way = rng.standard_normal(part.shape[1])
        for _ in range(6):
            way = centred.T @ (centred @ way)
            length = np.linalg.norm(way)
            if length < 1e-30:
                break
            way /= length
        order = np.argsort(centred @ way, kind="stable")
        todo += [part[order[: len(part) // 2]], part[order[len(part) // 2 :]]]
    return out


class Lists:
    """Centroids and their graph."""

    def __init__(self, sample: np.ndarray, lists: int):
        unit = _unit(sample)
        self.centre = np.array(_leaves(unit, max(1, -(-len(unit) // lists)), np.random.default_rng(1)))
        n = len(self.centre)
        near = []
        for at in range(0, n, 512):
            d = self.far(self.centre[at : at + 512][:, None], self.centre[None])
            near.append(np.argsort(d, axis=1, kind="stable")[:, 1 : DEGREE + 1])
        # A few long links keep the graph connected.
        jumps = (np.arange(n)[:, None] + np.array([1, n // 7 + 1, n // 3 + 1])) % n
        self.near = np.concatenate((np.concatenate(near), jumps), axis=1)
        self.start = np.unique(np.linspace(0, n - 1, 8).astype(int))

    @staticmethod
    def far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        d = a - b
        return np.sqrt(np.einsum("...d,...d->...", d, d))

    def within(self, x: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, list, distance) of the lists within ``reach`` times the distance of the nearest, by a walk from
        centroid to neighbouring centroid that goes on from every one within that reach."""
        n, c = len(x), len(self.centre)
        seen = np.zeros((n, c), bool)
        seen[:, self.start] = True
        row, col = np.nonzero(seen)
        dist = np.full((n, c), np.inf)
        best = np.full(n, np.inf)
        while len(row):
            d = self.far(x[row], self.centre[col])
            dist[row, col] = d
            np.minimum.at(best, row, d)
            # At least the nearest one found so far is always left to go on from.
            go = d <= self._limit(best, reach)[row]
            row, col = np.repeat(row[go], self.near.shape[1]), self.near[col[go]].ravel()
            fresh = ~seen[row, col]
            pair = np.unique(row[fresh] * c + col[fresh])
            row, col = pair // c, pair % c
            seen[row, col] = True
        row, col = np.nonzero(np.isfinite(dist) & (dist <= self._limit(best, reach)[:, None]))
        return row, col, dist[row, col]

    @staticmethod
    def _limit(best: np.ndarray, reach: float) -> np.ndarray:
        return best * reach + 1e-12 if np.isfinite(reach) else np.full(len(best), np.inf)

    def step(self, most: int = 1000) -> int:
        return max(1, min(most, WALK // len(self.centre)))

    def homes(self, x: np.ndarray, reach: float, most: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of at most ``most`` lists within ``reach``, the nearest ones."""
        rows, cols, step = [], [], self.step()
        for at in range(0, len(x), step):
            row, col, dist = self.within(x[at : at + step], reach)
            if most:
                order = np.lexsort((col, dist, row))
                row, col = row[order], col[order]
                nth = np.arange(len(row)) - np.searchsorted(row, row)
                row, col = row[nth < most], col[nth < most]
            rows.append(row + at)
            cols.append(col)
        return (np.concatenate(rows), np.concatenate(cols)) if rows else (np.zeros(0, int), np.zeros(0, int))


def fit(vectors: DataFrame, total: int, list_rows: int = LIST_ROWS) -> Lists | None:
    """Lists from at most ``SAMPLE`` vectors, chosen by the hash of their ids."""
    chosen = sample(vectors, F.col("vec_id"), SAMPLE).select("v").toArrow()["v"].to_pylist()
    if not chosen:
        return None
    return Lists(np.array(chosen), min(MAX_LISTS, max(1, total // list_rows), len(chosen)))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _place(lists: Lists, key: str, reach: float, most: int | None):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = lists.step()
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                row, col = lists.homes(_unit(_matrix(batch.column("v"))), reach, most)
                taken = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([taken.column(key), taken.column("v"), pa.array(col.astype(np.int32))], names=[key, "v", "list"])

    return place


def _scan(k: int):
    def scan(key, vectors: pa.Table, queries: pa.Table) -> pa.Table:
        """The nearest ``k`` vectors of a chunk for each query of its list."""
        out = ([], [], [])
        if vectors.num_rows and queries.num_rows:
            ids = vectors["vec_id"].to_numpy()
            ids, one = np.unique(ids, return_index=True)
            v, q, qid = _matrix(vectors["v"])[one], _matrix(queries["v"]), queries["q"].to_numpy()
            if v.shape[1] == q.shape[1]:
                vn, qn = np.sqrt(np.einsum("ij,ij->i", v, v)), np.sqrt(np.einsum("ij,ij->i", q, q))
                step = max(1, 4_000_000 // len(ids))
                for at in range(0, len(qid), step):
                    # One sum a pair, always in the same order: equal vectors get equal scores.
                    dots = np.einsum("qd,vd->qv", q[at : at + step], v)
                    score = dots / (qn[at : at + step, None] * vn[None])
                    if len(ids) > 4 * k:
                        edge = np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k]
                        row, col = np.nonzero(score >= edge[:, None])
                    else:
                        row, col = np.nonzero(np.ones(score.shape, bool))
                    s = score[row, col]
                    order = np.lexsort((ids[col], -s, row))
                    row, col, s = row[order], col[order], s[order]
                    nth = np.arange(len(row)) - np.searchsorted(row, row)
                    keep = nth < k
                    for o, x in zip(out, (qid[at + row[keep]], ids[col[keep]], s[keep])):
                        o.append(x)
        cols = [np.concatenate(o) if o else np.zeros(0, t) for o, t in zip(out, (np.int64, np.int64, np.float64))]
        return pa.table([pa.array(c) for c in cols], names=["q", "vec_id", "score"])

    return scan


def _best(q: np.ndarray, k: int):
    """The best ``k`` vectors of a task for each row of ``q``, by brute force."""
    qn = np.sqrt(np.einsum("ij,ij->i", q, q))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, ids, v = np.zeros((len(q), 0)), np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0, q.shape[1]))
        for whole in batches:
            for at in range(0, whole.num_rows, 4000):
                batch = whole.slice(at, 4000)
                x, own = _matrix(batch.column("v")), batch.column("vec_id").to_numpy()
                if x.shape[1] != q.shape[1]:
                    continue
                own, one = np.unique(own, return_index=True)
                x = x[one]
                s = np.einsum("qd,vd->qv", q, x) / (qn[:, None] * np.sqrt(np.einsum("ij,ij->i", x, x))[None])
                top = np.argsort(-s, axis=1, kind="stable")[:, :k]
                score, ids, v = np.hstack((score, np.take_along_axis(s, top, 1))), np.hstack((ids, own[top])), np.concatenate((v, x[top]), axis=1)
                order = np.lexsort((ids, -score))
                score, ids, v = np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1), np.take_along_axis(v, order[:, :, None], 1)
                # A repeated row counts once.
                score[:, 1:][ids[:, 1:] == ids[:, :-1]] = -np.inf
                order = np.argsort(-score, axis=1, kind="stable")[:, :k]
                score, ids, v = np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1), np.take_along_axis(v, order[:, :, None], 1)
        at = np.repeat(np.arange(len(q)), score.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(ids.ravel()), pa.array(score.ravel()), pa.array(v.reshape(-1, q.shape[1]).tolist(), pa.list_(pa.float64()))], names=["at", "vec_id", "score", "v"])

    return best


def enough(lists: Lists, q: np.ndarray, at: np.ndarray, hits: np.ndarray, copies: int, closure: float, aim: float = AIM) -> tuple[float, float]:
    """The least reach, from ``REACH`` on, by which the rows of ``q`` meet the share ``aim`` of their nearest vectors
    ``hits`` (``at``: the row of ``q`` of each), and that share."""
    q = _unit(q)
    row, col = lists.homes(_unit(hits), closure, copies)

    def met(reach: float) -> float:
        read = np.zeros((len(q), len(lists.centre)), bool)
        read[lists.homes(q, reach, None)] = True
        found = np.zeros(len(hits), bool)
        np.logical_or.at(found, row, read[at[row], col])
        return float(found.mean())

    far = np.sqrt(np.maximum(2e-16, np.stack([((x - lists.centre) ** 2).sum(axis=1) for x in q])))
    ratio = np.full(len(hits), np.inf)
    np.minimum.at(ratio, row, far[at[row], col] / far.min(axis=1)[at[row]])
    ratio.sort()
    reach = max(REACH, float(ratio[int(np.ceil(aim * len(ratio))) - 1]))
    # The walk can miss a list that is near enough.
    while (share := met(reach)) < aim:
        reach = reach * 1.03 if reach < ratio[-1] else float("inf")
    return reach, share


def measured_reach(lists: Lists, vectors: DataFrame, asked: DataFrame, k: int, copies: int, closure: float) -> float:
    """The reach for the queries (q, v) of ``asked``, from at most ``TRIED`` of them."""
    q = sample(asked, F.col("q"), TRIED).select("v").toArrow()["v"].to_pylist()  # at most TRIED rows
    if not q or len(lists.centre) == 1:
        return REACH
    q = np.array(q)
    top = W.partitionBy("at").orderBy(F.desc("score"), "vec_id")
    tops = vectors.mapInArrow(_best(q, k + 1), "at long, vec_id long, score double, v array<double>").where(F.col("score") > float("-inf"))
    best = tops.dropDuplicates(["at", "vec_id"]).withColumn("n", F.row_number().over(top))
    # The first is the query itself or a vector like it, which is met anyway.
    rows = best.where((F.col("n") > 1) & (F.col("n") <= k + 1)).select("at", "v").toArrow()
    return enough(lists, q, rows["at"].to_numpy(), np.array(rows["v"].to_pylist()), copies, closure)[0] if rows.num_rows else REACH


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, reach: float | None = None, copies: int = COPIES, closure: float = CLOSURE, list_rows: int = LIST_ROWS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row (vec_id, v) of ``queries`` its ``k`` nearest other vectors found,
    in the lists within ``reach`` or, without one, within the reach that the measured recall takes."""
    total = vectors.count()
    lists = fit(vectors, total, list_rows)
    spark = vectors.sparkSession
    if lists is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # Equal query vectors are one query; each may find itself, so one more is looked for.
    asked = table(queries.select(F.col("vec_id").alias("query_id"), "v", F.xxhash64("v", F.lit(0)).alias("q")), "asked")
    distinct = asked.groupBy("q", "v").agg(F.lit(1).alias("one")).select("q", "v")
    if reach is None:
        reach = measured_reach(lists, vectors, distinct, k, copies, closure)
    posted = table(vectors.mapInArrow(_place(lists, "vec_id", closure, copies), "vec_id long, v array<double>, list int"), "postings")
    sizes = table(posted.groupBy("list").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")), "sizes")  # at most MAX_LISTS rows
    chunked = posted.join(F.broadcast(sizes), "list").select("list", F.pmod(F.xxhash64("vec_id"), F.col("chunks")).cast("int").alias("chunk"), "vec_id", "v")
    probes = (
        distinct.mapInArrow(_place(lists, "q", reach, None), "q long, v array<double>, list int")
        .join(F.broadcast(sizes), "list")
        .select("list", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "q", "v")
    )
    met = chunked.groupBy("list", "chunk").cogroup(probes.groupBy("list", "chunk")).applyInArrow(_scan(k + 1), "q long, vec_id long, score double")
    best = W.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    found = met.dropDuplicates(["q", "vec_id"]).withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    own = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    answer = asked.select("query_id", "q").distinct().join(found, "q").where("query_id <> vec_id").withColumn("rank", F.row_number().over(own))
    return answer.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(embeddings: DataFrame, every: int = 50, k: int = K) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the rows whose ``vec_id`` is divisible by ``every`` against all rows.

    Vectors that are null, zero, or hold a null or non-finite component take no part; fewer than ``k`` candidates are
    all returned; equal scores go to the smaller id; a repeated row counts once. Vectors of another length than a
    list's first are not met. Other columns are ignored.
    """
    vectors = usable(embeddings)
    return nearest(vectors, vectors.where(F.col("vec_id") % every == 0), k)
