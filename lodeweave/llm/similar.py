"""One document of each group of similar texts: SimHash and covering tables find pairs, Jaccard confirms them.

A radius that holds all texts of one similarity is too wide for covering tables over the whole print (2^(radius + 1) - 1
of them). So a longer print is cut into parts, each with covering tables of a small radius: a pair within that
radius in any part meets for certain, a wider one with the chance that its differing bits leave some table's bits alone.
``plan`` sets the bits of a part by the number of texts, so that buckets stay small at any size, and takes as many parts as
bring a pair at the asked similarity together with probability ``RECALL``, by the radius that costs least.

A bucket gives a minimum spanning forest of its prints by differing bits, cut at ``most`` bits, and not its pairs: what is
joined by close pairs is joined by the forest. Edges are kept if the word-shingle sets agree by ``similarity``
or more. Buckets over ``LARGE`` are cut into blocks, and each two blocks are compared in a bucket of their own: no pair that
shares a bucket is missed, a task's memory is bounded, and the work grows with the square of such a bucket.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType

from lodeweave.llm.common import mix, pieces, table
from lodeweave.llm.simhash import _LANES, _hashes, _signed
from lodeweave.operators.iterate import components
from lodeweave.session import discard

WIDTH = 5
SIMILARITY = 0.8
RECALL = 0.95
NAMED = 2  # words of 64 bits of a print, named in edges and compared
WORD_COST = 15  # tables that take as long as a word of the print, as measured
LARGE = 2048
SMALL = 32


def differing(similarity: float) -> float:
    """Chance that a bit differs between prints of sets with this Jaccard similarity (sets of one size)."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def _spans(d: int, k: int) -> float:
    """Chance that ``d`` random non-zero vectors of ``k`` bits span all dimensions (Moebius inversion over the subspaces)."""
    out = 0.0
    for j in range(k + 1):
        subspaces = math.prod(((1 << (k - i)) - 1) / ((1 << (i + 1)) - 1) for i in range(j))
        out += (-1) ** (k - j) * 2.0 ** math.comb(k - j, 2) * subspaces * (((1 << j) - 1) / ((1 << k) - 1)) ** d
    return out


def chance(bits: int, radius: int, p: float) -> float:
    """Chance that two parts of ``bits`` bits, each differing with chance ``p``, meet in a covering table of ``radius``:
    that the vectors of the differing bits do not span all ``radius + 1`` dimensions."""
    met = 0.0
    for d in range(bits + 1):
        spans = _spans(d, radius + 1) if d > radius else 0.0
        met += math.comb(bits, d) * p**d * (1 - p) ** (bits - d) * (1 - spans)
    return met


@dataclass(frozen=True)
class Plan:
    bits: int
    radius: int
    parts: int
    most: int

    @property
    def words(self) -> int:
        return max(NAMED, -(-self.parts * self.bits // 64))

    def masks(self) -> list[list[dict[int, int]]]:
        """For each part its tables: the bits a table looks at, as masks by word of the print."""
        size = (1 << (self.radius + 1)) - 1
        out = []
        for part in range(self.parts):
            places = range(part * self.bits, (part + 1) * self.bits)
            tables = []
            for v in range(1, size + 1):
                looks: dict[int, int] = {}
                for k, b in enumerate(places):
                    if ((1 + k % size) & v).bit_count() % 2:
                        looks[b // 64] = looks.get(b // 64, 0) | 1 << b % 64
                tables.append(looks)
            out.append(tables)
        return out


def _looked_at(bits: int, radius: int) -> list[int]:
    """How many bits each table of a part looks at."""
    size = (1 << (radius + 1)) - 1
    return [sum(((1 + k % size) & v).bit_count() % 2 for k in range(bits)) for v in range(1, size + 1)]


def plan(n: int, similarity: float = SIMILARITY, recall: float = RECALL) -> Plan:
    """Tables for ``n`` prints: the cheapest that reach ``recall`` at ``similarity`` when a table looks at log2(n) bits or more,
    so that a bucket holds about one print by chance. The number of tables grows with n to the power of about a quarter."""
    p = differing(similarity)
    looks = max(18, math.ceil(math.log2(max(n, 1))))
    ways = []
    for radius in range(1, 8):
        tables = (1 << (radius + 1)) - 1
        bits = math.ceil(looks * tables / (1 << radius))
        while min(_looked_at(bits, radius)) < looks:
            bits += 1
        parts = math.ceil(math.log(1 - recall) / math.log(1 - chance(bits, radius, p)))
        ways.append((parts * tables + WORD_COST * parts * bits / 64, bits, radius, parts))
    _, bits, radius, parts = min(ways)
    compared = 64 * NAMED
    return Plan(bits, radius, parts, math.floor(compared * p + 4 * math.sqrt(compared * p * (1 - p))))


def _majority(flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A word of the print of each text: the bits set in over half of its hashes."""
    total = np.zeros((len(counts), 64), np.int64)
    if len(flat):
        lanes = _LANES[flat.view(np.uint8).reshape(-1, 8)]
        starts = np.cumsum(counts) - counts
        # Eight counters in a word hold sums of up to 255 rows.
        cuts = np.concatenate([np.arange(s, s + c, 255) for s, c in zip(starts.tolist(), counts.tolist()) if c])
        part = np.add.reduceat(lanes, cuts, axis=0).view(np.uint8).reshape(len(cuts), 64)
        has = np.flatnonzero(counts)
        of = np.repeat(np.arange(len(counts)), -(-counts // 255))
        total[has] = np.add.reduceat(part.astype(np.int64), np.searchsorted(of, has), axis=0)
    return np.packbits(2 * total > counts[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def prints_of(rows: DataFrame, words: int, width: int = WIDTH) -> DataFrame:
    """``(r, w0, w1, ..., s)`` of rows ``(r, text)``: the print's words and the set of 32-bit shingle hashes. A text of fewer
    words than a shingle hashes as one; one without a word has print zero and an empty set. A to Z are lower-cased."""
    schema = rows.select("r").schema
    for k in range(words):
        schema = schema.add(f"w{k}", LongType())
    schema = schema.add("s", ArrayType(IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            lists = [sorted(set(_hashes(t, width))) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            counts = np.array([len(x) for x in lists], np.int64)
            flat = np.array([h for x in lists for h in x], np.uint64)
            seeds = mix(np.arange(1, words + 1, dtype=np.uint64))
            found = [pa.array(_majority(mix(flat ^ seed), counts).view(np.int64)) for seed in seeds]
            offsets = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
            sets = pa.ListArray.from_arrays(offsets, pa.array(flat.astype(np.uint32).view(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("r"), *found, sets], names=schema.names)

    return rows.mapInArrow(run, schema)


def _named(looks: dict[int, int], *more: Column) -> Column:
    return F.xxhash64(*more, *[F.col(f"w{k}").bitwiseAND(F.lit(_signed(m))) for k, m in looks.items()])


def buckets(units: DataFrame, how: Plan, large: int = LARGE) -> DataFrame:
    """``(name, w0, w1)``: the prints of each bucket, at most about ``large`` in one. A larger bucket is cut into blocks of about
    half of ``large``, and each two blocks make a bucket, so that any two of its prints still meet."""
    looks = how.masks()
    own = [f"w{k}" for k in range(NAMED)]
    flat = [t for tables in looks for t in tables]
    first = F.array(*[_named(t, F.lit(k)) for k, t in enumerate(flat)])
    rows = units.select(*own, F.explode(first).alias("name"))

    hot = table(rows.groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") > large), "large")
    if hot.isEmpty():
        return rows.select("name", *own)
    cool = rows.join(hot, "name", "left_anti").select("name", *own)
    blocks = F.ceil(2 * F.col("n") / F.lit(large)).cast("long")
    dealt = rows.join(hot, "name").select("name", *own, F.pmod(F.xxhash64(*own), blocks).alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("c"))
    pairs = dealt.where("b <> c").select(F.xxhash64("name", F.least("b", "c"), F.greatest("b", "c")).alias("name"), *own)
    return cool.union(pairs)


def _forest(a: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Edges of a minimum spanning forest of the rows of ``a`` (Prim), of at most ``most`` differing bits."""
    left = np.arange(1, len(a))
    at = 0
    best = np.full(len(left), 1 << 20)
    parent = np.zeros(len(left), np.int64)
    while len(left):
        d = np.bitwise_count(a[left] ^ a[at]).sum(axis=1, dtype=np.int64)
        closer = d < best
        best[closer], parent[closer] = d[closer], at
        k = int(best.argmin())
        at = int(left[k])
        if best[k] <= most:
            yield int(parent[k]), at
        left, best, parent = np.delete(left, k), np.delete(best, k), np.delete(parent, k)


def _small_forests(name: np.ndarray, a: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """The same for all buckets of up to ``SMALL`` rows at once (Kruskal)."""
    src, dst, far = [], [], []
    live = np.arange(len(name))
    for gap in range(1, SMALL):
        live = live[live + gap < len(name)]
        live = live[name[live] == name[live + gap]]
        if not len(live):
            break
        d = np.bitwise_count(a[live] ^ a[live + gap]).sum(axis=1, dtype=np.int64)
        near = d <= most
        src.append(live[near])
        dst.append(live[near] + gap)
        far.append(d[near])
    if not src:
        return
    src, dst, far = np.concatenate(src), np.concatenate(dst), np.concatenate(far)
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    for k in np.argsort(far, kind="stable").tolist():
        i, j = int(src[k]), int(dst[k])
        x, y = find(i), find(j)
        if x != y:
            root[y] = x
            yield i, j


def _edges_in(most: int):
    names = [f"{side}{k}" for side in "ab" for k in range(NAMED)]

    def edges(name: np.ndarray, a: np.ndarray) -> pa.RecordBatch:
        heads = np.flatnonzero(np.concatenate(([True], name[1:] != name[:-1])))
        sizes = np.diff(np.concatenate((heads, [len(name)])))
        few = np.repeat(sizes <= SMALL, sizes)
        at = np.flatnonzero(few)
        found = [(at[i], at[j]) for i, j in _small_forests(name[few], a[few], most)]
        for h, s in zip(heads[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
            found += [(h + i, h + j) for i, j in _forest(a[h : h + s], most)]
        pairs = np.array(found, np.int64).reshape(-1, 2)
        cols = [pa.array(a[pairs[:, side], k].view(np.int64)) for side in (0, 1) for k in range(NAMED)]
        return pa.RecordBatch.from_arrays(cols, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, a = np.zeros(0, np.int64), np.zeros((0, NAMED), np.uint64)
        for batch in batches:
            got = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            name = np.concatenate((name, got[0]))
            a = np.concatenate((a, np.stack(got[1:], axis=1).astype(np.int64).view(np.uint64)))
            # The last bucket may go on in the next batch.
            whole = int(np.searchsorted(name, name[-1])) if len(name) else 0
            if whole:
                yield edges(name[:whole], a[:whole])
                name, a = name[whole:], a[whole:]
        if len(name):
            yield edges(name, a)

    return run, ", ".join(f"{c} long" for c in names)


def links(prints: DataFrame, units: DataFrame, how: Plan, similarity: float = SIMILARITY, large: int = LARGE) -> DataFrame:
    """``(src, dst)``: pairs of units (as hex) whose sets agree by ``similarity`` or more, enough to join each
    group of them. ``units``: the distinct prints and the least row ``own`` of each."""
    run, schema = _edges_in(how.most)
    dealt = buckets(units, how, large).repartition("name").sortWithinPartitions("name")
    edges = table(dealt.mapInArrow(run, schema).distinct(), "edges")
    a, b = ([f"{side}{k}" for k in range(NAMED)] for side in "ab")
    own = [f"w{k}" for k in range(NAMED)]
    met = edges.select(*[F.col(c).alias(w) for c, w in zip(a, own)]).union(edges.select(*b)).distinct()
    reps = units.join(met, own, "left_semi").select(F.col("own").alias("r"))
    sets = table(prints.join(reps, "r", "left_semi").groupBy(*own).agg(F.any_value("s").alias("s")), "sets")
    # Spark sizes an array as one element and might send the sets to all tasks by mistake: they are merged.
    shared = F.size(F.array_intersect("s", "t"))
    left = sets.select(*[F.col(w).alias(c) for c, w in zip(a, own)], "s").hint("merge")
    right = sets.select(*[F.col(w).alias(c) for c, w in zip(b, own)], F.col("s").alias("t")).hint("merge")
    near = edges.join(left, a).join(right, b).where(shared / (F.size("s") + F.size("t") - shared) >= similarity)
    out = table(near.select(_hex(*a).alias("src"), _hex(*b).alias("dst")), "links")
    for used in (edges, sets):
        discard(used)
    return out


def _hex(*words: str) -> Column:
    return F.concat(*[F.lpad(F.hex(w), 16, "0") for w in words])


def keep_one(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, large: int = LARGE) -> DataFrame:
    """``docs`` with one row of each group of near copies: texts joined by chains of pairs whose sets of ``width``-word
    shingles agree by ``similarity`` or more, and texts of one print. The row with the least id stays (a null id comes
    last; on equal ids the least hash of the row decides, and of equal rows one stays).

    Null texts and texts without a word are one group, and link to no other.
    """
    row = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").cast("long").alias("i"), F.xxhash64(*docs.columns).alias("h"))
    how = plan(docs.count(), similarity)
    prints = table(prints_of(docs.select(row.alias("r"), F.col("text").cast("string").alias("text")), how.words, width), "fingerprints")
    words = [f"w{k}" for k in range(how.words)]
    own = words[:NAMED]
    units = table(prints.groupBy(*own).agg(*[F.any_value(w).alias(w) for w in words[NAMED:]], F.min("r").alias("own")).select(*words, "own"), "prints")
    joined = links(prints, units, how, similarity, large)
    discard(prints)
    found = table(components(joined), "groups")
    rooted = units.select(_hex(*own).alias("node"), "own").join(found, "node", "left")
    kept = rooted.groupBy(F.coalesce("component", "node").alias("root")).agg(F.min("own").alias("own"))
    kept = table(kept.select(F.coalesce("own.i", F.lit(0)).alias("_keep_i"), F.col("own.h").alias("_keep_h")), "kept")
    keyed = docs.withColumns({"_keep_i": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "_keep_h": F.xxhash64(*docs.columns)})
    return keyed.join(kept, ["_keep_i", "_keep_h"], "left_semi").dropDuplicates(["_keep_i", "_keep_h"]).select(*docs.columns)
