"""Vector retrieval: exact, inverted lists, hyperplane buckets, diversity re-ranking.

Questions are ``(q_id, embedding)``; vectors are ``(id, embedding)``.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.functions.vector import dot, norm
from lodeweave.operators.best import SCORE_DIGITS, Best
from lodeweave.operators.retrieve import top_k
from lodeweave.session import cut, discard


#: Most lists that a task holds the pivots of.
MAX_LISTS = 4096
#: Vectors that a hyperplane bucket is meant to hold.
BUCKET_ROWS = 8
#: Questions whose exact answers decide how far an approximate search reads, and the hundredths of their neighbours that it must find.
TRIALS, FOUND = 100, 95
#: Most bits in which a probed bucket differs from the question's own.
FLIPS = 4


def list_count(vectors: DataFrame) -> int:
    """Lists for a number of vectors: its square root, so lists and pivots grow alike."""
    return max(1, min(MAX_LISTS, math.ceil(math.sqrt(vectors.count()))))


def code_bits(n: int) -> int:
    """Bits of a bucket code that leave about ``BUCKET_ROWS`` of ``n`` vectors in a bucket, however many there are."""
    return max(1, math.ceil(math.log2(max(n, 1) / BUCKET_ROWS)))


def unit(df: DataFrame, col: str = "embedding") -> DataFrame:
    """Scale vectors to length one, in double; a zero vector stays zero."""
    size = norm(col)
    return df.withColumn("_n", size).withColumn(
        col,
        F.transform(col, lambda x: F.when(F.col("_n") == 0, 0.0).otherwise(x.cast("double") / F.col("_n"))),
    ).drop("_n")


def whole(df: DataFrame, col: str = "embedding") -> DataFrame:
    """Rows whose vector is there and holds no null; others take no part in a search."""
    return df.where(F.col(col).isNotNull() & F.forall(col, lambda x: x.isNotNull()))


#: Differences between vectors and pivots that a task holds at a time.
CELLS = 4_000_000


class Pivots:
    """The pivots of all lists, at most ``MAX_LISTS``, in the order of their lists; every task gets a copy."""

    def __init__(self, pivots: DataFrame):
        rows = sorted((r["list"], r["pivot"]) for r in pivots.collect())
        self.lists = np.array([r[0] for r in rows], object)
        self.points = np.array([r[1] for r in rows], float)
        self.kind = dict(pivots.dtypes)["list"]

    def squared(self, m: np.ndarray) -> Iterator[np.ndarray]:
        """Squared distances of some rows of ``m`` at a time to all pivots."""
        step = max(1, CELLS // max(self.points.size, 1))
        for at in range(0, len(m), step):
            gap = m[at : at + step, None] - self.points
            yield np.einsum("nld,nld->nl", gap, gap)

    def nearest(self, embedding: str) -> Column:
        """A struct of the nearest list, the least on ties, and its distance."""

        def find(col: pd.Series) -> pd.DataFrame:
            parts = list(self.squared(np.vstack(col.to_numpy()).astype(float))) if len(col) else []
            at = np.concatenate([d.argmin(axis=1) for d in parts]) if parts else np.zeros(0, int)
            far = np.sqrt(np.concatenate([d.min(axis=1) for d in parts])) if parts else np.zeros(0)
            return pd.DataFrame({"list": self.lists[at], "dist": far})

        find.__annotations__ = {"col": pd.Series, "return": pd.DataFrame}
        return F.pandas_udf(find, f"list {self.kind}, dist double")(embedding)

    def order(self, embedding: str, n: int | None = None) -> Column:
        """The ``n`` nearest lists, nearest first, or all."""

        def find(col: pd.Series) -> pd.Series:
            parts = self.squared(np.vstack(col.to_numpy()).astype(float)) if len(col) else []
            return pd.Series([row for d in parts for row in self.lists[d.argsort(axis=1, kind="stable")[:, :n]].tolist()], dtype=object)

        find.__annotations__ = {"col": pd.Series, "return": pd.Series}
        return F.pandas_udf(find, f"array<{self.kind}>")(embedding)


def place(vectors: DataFrame, pivots: DataFrame, id_col: str = "id") -> DataFrame:
    """``(id, embedding, list, dist)``: each vector in the list of its nearest pivot ``(list, pivot)``. Nothing is shuffled."""
    held = Pivots(pivots)
    if not len(held.lists):
        return cut(vectors.select(id_col, "embedding", F.lit(None).cast(held.kind).alias("list"), F.lit(None).cast("double").alias("dist")).limit(0))
    found = vectors.select(id_col, "embedding", held.nearest("embedding").alias("n"))
    return cut(found.select(id_col, "embedding", F.col("n.list").alias("list"), F.col("n.dist").alias("dist")))


def assign_lists(vectors: DataFrame, n_lists: int, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """Put each unit vector in the list of its nearest pivot; pivots are the ``n_lists`` vectors with the least
    hash of their id. Returns ``(id, embedding, list, dist)`` and the pivots ``(list, pivot)``."""
    picked = vectors.orderBy(F.md5(F.col(id_col).cast("string")), id_col).limit(n_lists)
    pivots = cut(picked.select(F.col(id_col).alias("list"), F.col("embedding").alias("pivot")))
    return place(vectors, pivots, id_col), pivots


def mean_lists(vectors: DataFrame, n_lists: int, rounds: int, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """``assign_lists`` followed by ``rounds`` of Lloyd's algorithm: the mean of a list is its next pivot. A list
    that loses all its vectors goes. The rounds have no random part."""
    placed, pivots = assign_lists(vectors, n_lists, id_col)
    dim = placed.agg(F.max(F.size("embedding"))).first()[0] or 0
    for _ in range(rounds if dim else 0):
        means = placed.groupBy("list").agg(F.array(*[F.avg(F.col("embedding")[i]) for i in range(dim)]).alias("pivot"))
        old, pivots = (placed, pivots), cut(means)
        placed = place(vectors, pivots, id_col)
        for table in old:
            discard(table)
    return placed, pivots


#: Vectors, and questions, that a task of a search holds, and questions whose scores it holds at a time.
BLOCK, ASKED = 65_536, 256


def _by_lists(held: Pivots, n_probe: int | None) -> Callable:
    """Compares questions with the vectors of the ``n_probe`` nearest lists or, without ``n_probe``, of all lists that can hold a better one."""

    def compare(q: np.ndarray, v: np.ndarray, lists: np.ndarray, best: Best) -> None:
        place = pd.Index(held.lists).get_indexer(lists)
        order = np.argsort(place, kind="stable")
        ends = np.searchsorted(place[order], np.arange(len(held.lists) + 1))
        radius = np.zeros(len(held.lists))
        np.maximum.at(radius, place, np.linalg.norm(v - held.points[place], axis=1))
        # Questions of one list come together, so they read the same lists.
        far = np.concatenate(list(held.squared(q)))
        nearest = far.argmin(axis=1)
        turn = np.argsort(nearest, kind="stable")
        for at in range(0, len(turn), ASKED):
            rows = turn[at : at + ASKED]
            mine = far[rows]
            read = None
            if n_probe is not None:
                read = np.zeros(mine.shape, bool)
                np.put_along_axis(read, mine.argsort(axis=1, kind="stable")[:, :n_probe], True, axis=1)
            low = np.square(np.maximum(np.sqrt(mine) - radius, 0))
            left = [x for x in mine.min(axis=0).argsort(kind="stable") if ends[x] < ends[x + 1] and (read is None or read[:, x].any())]
            step = 1024
            while left:
                if read is None:
                    # |q - v|^2 = 2 - 2 cos, or 1 if the question is zero; the slack covers rounding.
                    open_ = (low[:, left] <= 2 - 2 * best.floor(rows)[:, None] + 4e-6).any(axis=0)
                    left = [x for x, o in zip(left, open_) if o]
                sizes = np.cumsum([ends[x + 1] - ends[x] for x in left])
                n = int(np.searchsorted(sizes, step, side="right")) + 1
                now, left = left[:n], left[n:]
                cols = np.concatenate([order[ends[x] : ends[x + 1]] for x in now]) if now else np.zeros(0, int)
                # A list may be long.
                for part in range(0, len(cols), CELLS // ASKED):
                    c = cols[part : part + CELLS // ASKED]
                    s = q[rows] @ v[c].T
                    if read is not None:
                        s[~read[:, place[c]]] = -np.inf
                    best.offer(rows, c, s)
                step = CELLS // ASKED

    return compare


def _by_buckets(normals: np.ndarray, sets: np.ndarray, n_probe: int) -> Callable:
    """Compares questions with the vectors in the ``n_probe`` nearest buckets of each table."""
    power = 1 << np.arange(normals.shape[1])
    masks = sets @ power

    def compare(q: np.ndarray, v: np.ndarray, lists: np.ndarray | None, best: Best) -> None:
        n_codes = 1 << normals.shape[1]
        tables = []
        for t in range(len(normals)):
            code = (_sides(v, normals[t : t + 1])[:, 0] > 0) @ power
            order = np.argsort(code, kind="stable")
            tables.append((order, np.searchsorted(code[order], np.arange(n_codes + 1))))
        wide = max(1, min(ASKED, CELLS // max(len(v), 1)))
        for at in range(0, len(q), wide):
            rows = np.arange(at, min(at + wide, len(q)))
            met = np.zeros((len(rows), len(v)), bool)
            for t, (order, ends) in enumerate(tables):
                sides = _sides(q[rows], normals[t : t + 1])[:, 0]
                r, x = np.nonzero(_nearest_sets(sides, sets, n_probe))
                code = ((sides > 0) @ power)[r] ^ masks[x]
                first, n = ends[code], ends[code + 1] - ends[code]
                r, first, n = r[n > 0], first[n > 0], n[n > 0]
                places = np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)
                met[np.repeat(r, n), order[places]] = True
            if met.mean() > 0.02:
                best.offer(rows, np.arange(len(v)), np.where(met, q[rows] @ v.T, -np.inf))
            else:
                r, c = np.nonzero(met)
                if best.own is not None:
                    r, c = r[best.own[rows[r]] != c], c[best.own[rows[r]] != c]
                best.add(rows[r], c, np.einsum("nd,nd->n", q[rows[r]], v[c]))

    return compare


def _nearest_sets(sides: np.ndarray, sets: np.ndarray, n: int) -> np.ndarray:
    """Marks the first ``n`` flip sets in the order of ``_probe_order``."""
    cost = np.square(sides) @ sets.T
    if n >= cost.shape[1]:
        return np.ones(cost.shape, bool)
    last = np.partition(cost, n - 1, axis=1)[:, n - 1 : n]
    less, same = cost < last, cost == last
    return less | (same & (np.cumsum(same, axis=1) <= n - less.sum(axis=1, keepdims=True)))


def _matrix(col: pa.ChunkedArray) -> np.ndarray:
    values = col.combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(values), -1)


def probe(
    placed: DataFrame,
    questions: DataFrame,
    k: int,
    id_col: str,
    via: str,
    compare: Callable,
    exclude_self: bool = False,
    rows_per_task: int = BLOCK,
) -> DataFrame:
    """Best ``k`` of ``placed`` ``(id, embedding[, list])`` for the ``questions`` ``(q_id, embedding)``, all unit vectors.

    Blocks of questions meet blocks of vectors, each at most about ``rows_per_task`` long: ``compare`` scores the pairs it reads as products of matrices
    and keeps the best ``k``. So a vector is sent once a block of questions and a question once a block of vectors; no
    pair and no probed list is a row.
    """
    nq, nv = questions.count(), placed.count()
    a, b = max(1, math.ceil(nq / rows_per_task)), max(1, math.ceil(nv / rows_per_task))
    while a * b < 2 * placed.sparkSession.sparkContext.defaultParallelism and (nq > ASKED * a or nv > ASKED * b):
        a, b = (a + 1, b) if nq * b > nv * a else (a, b + 1)
    n = max(int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")), a * b)

    def dealt(df: DataFrame, key: str, own: int, others: int, cell: Callable[[Column, Column], Column], *more: str) -> DataFrame:
        block = F.pmod(F.xxhash64(key), F.lit(own)).cast("int")
        cells = F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
        return df.select(key, "embedding", *more, block.alias("_own"), cells.alias("_other")).select(
            cell(F.col("_own"), F.col("_other")).alias("cell"), key, "embedding", *more
        ).repartition(n, "cell")

    extra = ["list"] if "list" in placed.columns else []
    asked = dealt(questions, "q_id", a, b, lambda own, other: own * b + other)
    stored_ = dealt(placed, id_col, b, a, lambda own, other: other * b + own, *extra)
    kind = {**dict(questions.dtypes), **dict(placed.dtypes)}

    def meet(q: pa.Table, v: pa.Table) -> pa.Table:
        if not len(q) or not len(v):
            return pa.table({"q_id": q["q_id"].slice(0, 0), id_col: v[id_col].slice(0, 0), "score": pa.array([], pa.float64())})
        v = v.take(pc.sort_indices(v[id_col]))
        own = pc.index_in(q["q_id"], v[id_col].combine_chunks()).fill_null(-1).to_numpy() if exclude_self else None
        best = Best(len(q), min(k, len(v)), own)
        lists = np.array(v["list"].to_pylist(), object) if extra else None
        compare(_matrix(q["embedding"]), _matrix(v["embedding"]), lists, best)
        r, c = np.nonzero(best.score > -np.inf)
        return pa.table({"q_id": q["q_id"].take(pa.array(r)), id_col: v[id_col].take(pa.array(best.at[r, c])), "score": best.score[r, c]})

    scored = asked.groupBy("cell").cogroup(stored_.groupBy("cell")).applyInArrow(meet, f"q_id {kind['q_id']}, {id_col} {kind[id_col]}, score double")
    return top_k(scored, k, via, ties=id_col)


def knn(
    questions: DataFrame,
    vectors: DataFrame,
    k: int = 10,
    n_lists: int | None = None,
    id_col: str = "id",
    exclude_self: bool = False,
    rows_per_task: int = BLOCK,
) -> DataFrame:
    """Exact best ``k`` by cosine, without comparing every pair where the data allow.

    Vectors lie in lists around pivots, and a question reads the lists of a block from the nearest on. The worst of its best ``k`` is
    a bound: by the triangle inequality a list whose pivot is farther than bound plus list radius cannot improve on it.
    Without clusters all pairs are compared, as products of matrices.
    """
    v = cut(unit(whole(vectors.select(id_col, "embedding"))))
    q = cut(unit(whole(questions.select("q_id", "embedding"))))
    # Few questions do not pay for many lists.
    placed, pivots = assign_lists(v, n_lists or min(list_count(v), max(1, q.count() // 8)), id_col)
    return probe(placed.drop("dist"), q, k, id_col, "vector", _by_lists(Pivots(pivots), None), exclude_self, rows_per_task)


def trials(questions: DataFrame, vectors: DataFrame, k: int, id_col: str = "id") -> DataFrame:
    """``(q_id, qv, id, embedding)``: the exact best ``k`` of the at most ``TRIALS`` questions with the least hash of their
    id, all unit vectors. The questions reach the vectors as one scalar value, so only the best of a task are shuffled."""
    asked = cut(questions.orderBy(F.md5(F.col("q_id").cast("string")), "q_id").limit(TRIALS).select("q_id", F.col("embedding").alias("qv")))
    packed = asked.agg(F.array_sort(F.collect_list(F.struct("q_id", "qv"))).alias("qs")).scalar()
    scored = (
        vectors.select(id_col, "embedding", F.explode(packed).alias("q"))
        .select(F.col("q.q_id").alias("q_id"), id_col, F.round(dot("q.qv", "embedding"), SCORE_DIGITS).alias("score"))
    )
    best = cut(top_k(scored, k, "", ties=id_col).select("q_id", id_col))
    return best.join(asked, "q_id").join(vectors.select(id_col, "embedding"), id_col)


def enough(needs: list[int]) -> int:
    """The least reach that covers ``FOUND`` hundredths of the needs."""
    return sorted(needs)[-(-FOUND * len(needs) // 100) - 1] if needs else 1


def ivf(
    questions: DataFrame,
    vectors: DataFrame,
    k: int = 10,
    n_lists: int | None = None,
    n_probe: int | None = None,
    id_col: str = "id",
    rounds: int = 3,
) -> DataFrame:
    """Approximate best ``k`` over the ``n_probe`` nearest lists (Jégou et al. 2011).

    Without ``n_probe`` the number is measured: up to ``TRIALS`` questions are answered exactly, and as many lists are read as hold
    ``FOUND`` hundredths of their neighbours. Vectors with clusters need few lists, vectors without any need about half of
    them, at any size.
    """
    v = cut(unit(whole(vectors.select(id_col, "embedding"))))
    q = cut(unit(whole(questions.select("q_id", "embedding"))))
    placed, pivots = mean_lists(v, n_lists or list_count(v), rounds, id_col)
    held = Pivots(pivots)
    if n_probe is None:
        true = trials(q, v, k, id_col).join(placed.select(id_col, "list"), id_col)
        n_probe = enough([r[0] for r in true.select(F.array_position(held.order("qv"), F.col("list"))).collect()])  # at most TRIALS * k
    return probe(placed.drop("dist"), q, k, id_col, "ivf", _by_lists(held, n_probe))


def planes(dim: int, bits: int, tables: int) -> np.ndarray:
    """Fixed +1/-1 hyperplanes, from md5 bits of their position: ``(tables, bits, dim)``."""
    out = np.empty((tables, bits, dim))
    for t in range(tables):
        for b in range(bits):
            stream = b"".join(
                hashlib.md5(f"{t}:{b}:{i}".encode()).digest() for i in range((dim + 127) // 128)
            )
            sign = np.unpackbits(np.frombuffer(stream, dtype=np.uint8))[:dim]
            out[t, b] = np.where(sign == 1, 1.0, -1.0)
    return out


def flip_sets(bits: int) -> np.ndarray:
    """All sets of up to ``FLIPS`` bits, in order of their masks, as rows of zeros and ones."""
    masks = sorted(sum(1 << b for b in c) for n in range(min(FLIPS, bits) + 1) for c in itertools.combinations(range(bits), n))
    return (np.array(masks)[:, None] >> np.arange(bits)) & 1


def _sides(m: np.ndarray, normals: np.ndarray) -> np.ndarray:
    return np.einsum("nd,tbd->ntb", m, normals)


def _probe_order(sides: np.ndarray, sets: np.ndarray) -> np.ndarray:
    """For each row of distances to the planes of a table, the flip sets from the least to the most sum of squares."""
    return np.argsort(np.square(sides) @ sets.T, axis=-1, kind="stable")


def flip_needs(q: np.ndarray, v: np.ndarray, normals: np.ndarray, sets: np.ndarray) -> list[int]:
    """For each pair of a question and a neighbour, how many buckets of each table must be read until one holds it;
    one more than there are, if none does."""
    power = 1 << np.arange(normals.shape[1])
    masks = sets @ power
    needs = np.full(len(q), len(masks) + 1)
    for t in range(len(normals)):
        a, b = _sides(q, normals[t : t + 1])[:, 0], _sides(v, normals[t : t + 1])[:, 0]
        apart = ((a > 0) != (b > 0)) @ power
        order = _probe_order(a, sets)
        at = masks[order] == apart[:, None]
        needs = np.minimum(needs, np.where(at.any(axis=1), at.argmax(axis=1) + 1, len(masks) + 1))
    return needs.tolist()


def lsh(
    questions: DataFrame,
    vectors: DataFrame,
    k: int = 10,
    bits: int | None = None,
    tables: int = 8,
    dim: int = 64,
    n_probe: int | None = None,
    id_col: str = "id",
) -> DataFrame:
    """Approximate best ``k`` among vectors in the ``n_probe`` random-hyperplane buckets of each table nearest to a question.

    A bucket is near if the bits in which it differs from the question's own have small margins. Without ``n_probe`` the
    number is measured like that of ``ivf``. Where ``FLIPS`` bits do not reach far enough, all vectors are compared.
    """
    v = cut(unit(whole(vectors.select(id_col, "embedding"))))
    q = cut(unit(whole(questions.select("q_id", "embedding"))))
    bits = bits or code_bits(v.count())
    normals, sets = planes(dim, bits, tables), flip_sets(bits)
    if n_probe is None:
        true = trials(q, v, k, id_col).select("qv", "embedding").toPandas()  # at most TRIALS * k rows
        n_probe = enough(flip_needs(np.vstack(true["qv"]), np.vstack(true["embedding"]), normals, sets)) if len(true) else 1
        if n_probe > len(sets):
            return knn(q, v, k, id_col=id_col).withColumn("via", F.lit("lsh"))
    return probe(v, q, k, id_col, "lsh", _by_buckets(normals, sets, n_probe))


def mmr(hits: DataFrame, vectors: DataFrame, k: int = 5, lam: float = 0.7, pool: int | None = None, id_col: str = "chunk_id") -> DataFrame:
    """Re-rank each question's hits, or the best ``pool`` of them, by maximal marginal relevance
    (Carbonell & Goldstein 1998). A group holds one question's hits."""
    rows = (hits if pool is None else hits.where(F.col("rank") <= pool)).join(vectors.select(id_col, "embedding"), id_col)

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank").reset_index(drop=True)
        m = np.vstack(pdf["embedding"].to_numpy()).astype(float)
        size = np.linalg.norm(m, axis=1, keepdims=True)
        m = np.divide(m, size, out=np.zeros_like(m), where=size > 0)
        score = pdf["score"].to_numpy()
        top = np.abs(score).max()
        rel = score / top if top > 0 else score
        closest = np.zeros(len(pdf))
        free = np.ones(len(pdf), dtype=bool)
        chosen, values = [], []
        while free.any() and len(chosen) < k:
            gain = np.round(np.where(free, lam * rel - (1 - lam) * closest, -np.inf), 9)
            i = int(gain.argmax())
            chosen.append(i)
            values.append(float(gain[i]))
            free[i] = False
            closest = np.maximum(closest, m @ m[i])
        out = pdf.loc[chosen, ["q_id", id_col]].copy()
        out["score"] = np.round(values, SCORE_DIGITS)
        out["rank"] = range(1, len(chosen) + 1)
        out["via"] = "mmr"
        return out

    kind = dict(rows.dtypes)
    return rows.groupBy("q_id").applyInPandas(
        pick, f"q_id {kind['q_id']}, {id_col} {kind[id_col]}, score double, rank int, via string"
    )
