"""Near copies by SimHash, found with covering locality-sensitive hashing.

A fingerprint has a bit set where over half of a text's shingle hashes have it. Texts whose fingerprints
differ in at most ``radius`` bits are linked.

Covering LSH (Pagh 2016): give bit i of the fingerprint a non-zero vector m(i) of ``radius + 1`` bits, and let
table v, for each non-zero v, look at the bits with odd <m(i), v>. At most ``radius`` differing bits span a
space that some v is orthogonal to, so every pair within the radius agrees on all bits of some table: no
pair is missed. At radius 2 there are 7 tables, each of 36 or 37 bits.

Buckets hold distinct fingerprints, so exact copies are one row. A bucket of up to ``SMALL`` is compared inside a
task, which returns a spanning forest of its links. In a larger one every fingerprint names itself
and its neighbours at distance one on the bits that the table leaves out; two within distance 2 share such
a name, and a name has at most as many owners as there are bits left, plus one. So neither way lists the pairs of a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.llm.common import pieces, table
from lodeweave.operators.iterate import components

SEED = 42
WIDTH = 3
RADIUS = 2
SMALL = 32
# Byte k of entry v is bit k of v: eight counters in one word.
_LANES = np.array([sum(((v >> k) & 1) << (8 * k) for k in range(8)) for v in range(256)], np.uint64)


def _hashes(text: bytes | None, width: int) -> list[int]:
    found = (text or b"").lower().split()
    if not found:
        return []
    joined = b" ".join(found)
    digest = xxhash.xxh64_intdigest
    if len(found) <= width:
        return [digest(joined, SEED)]
    at, starts = 0, []
    for w in found:
        starts.append(at)
        at += len(w) + 1
    ends = [*starts[width:], at]
    return [digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends)]


def fingerprints(texts: list[bytes | None], width: int = WIDTH) -> np.ndarray:
    """64-bit fingerprint of each text; zero for a text without a word."""
    lists = [_hashes(t, width) for t in texts]
    counts = np.array([len(x) for x in lists], np.int64)
    total = np.zeros((len(texts), 64), np.int64)
    flat = np.array([h for x in lists for h in x], np.uint64)
    if len(flat):
        lanes = _LANES[flat.view(np.uint8).reshape(-1, 8)]
        # Sums of at most 255 rows fit a byte; no such stretch crosses a text.
        starts = np.cumsum(counts) - counts
        cuts = np.concatenate([np.arange(s, s + c, 255) for s, c in zip(starts.tolist(), counts.tolist()) if c])
        part = np.add.reduceat(lanes, cuts, axis=0).view(np.uint8).reshape(len(cuts), 64)
        of = np.repeat(np.arange(len(texts)), -(-counts // 255))
        has = np.flatnonzero(counts)
        total[has] = np.add.reduceat(part.astype(np.int64), np.searchsorted(of, has), axis=0)
    bits = 2 * total > counts[:, None]
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()


def masks(radius: int = RADIUS) -> list[int]:
    """The bits that each table looks at, as 64-bit masks."""
    size = (1 << (radius + 1)) - 1
    of = [1 + i % size for i in range(64)]
    return [sum(1 << i for i in range(64) if (of[i] & v).bit_count() % 2) for v in range(1, size + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forests(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            src, dst = [], []
            for prints in batch.column("prints").to_pylist():
                todo = sorted(prints)
                while todo:
                    reached = [todo.pop(0)]
                    for x in reached:
                        near = [y for y in todo if ((x ^ y) & (1 << 64) - 1).bit_count() <= radius]
                        src += [x] * len(near)
                        dst += near
                        reached += near
                        todo = [y for y in todo if y not in near] if near else todo
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    return run


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(src, dst)`` between distinct fingerprints ``fp``: links within the radius, enough of them to
    join every pair within it by a chain."""
    if radius != 2:
        raise ValueError("large buckets are split for radius 2")
    looks = masks(radius)
    keys = prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in looks])).alias("v", "key"))
    met = keys.groupBy("v", "key").agg(F.count("*").alias("size")).where("size > 1")
    rows = keys.join(met, ["v", "key"])
    small = (
        rows.where(F.col("size") <= SMALL)
        .groupBy("v", "key")
        .agg(F.collect_list("fp").alias("prints"))
        .select("prints")
        .mapInArrow(_forests(radius), "src long, dst long")
    )
    flips = F.element_at(F.array(*[F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(64) if not m >> i & 1]) for m in looks]), F.col("v") + 1)
    large = (
        rows.where(F.col("size") > SMALL)
        .select("fp", "v", F.explode(flips).alias("flip"))
        .groupBy("v", F.col("fp").bitwiseXOR(F.col("flip")).alias("name"))
        .agg(F.collect_list("fp").alias("prints"))
        .where(F.size("prints") > 1)
        .select(F.array_min("prints").alias("src"), F.explode("prints").alias("dst"))
        .where("src <> dst")
    )
    return small.union(large).distinct()


def prints_of(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """The columns of ``rows`` but ``text``, and ``fp`` (signed)."""
    kept = [c for c in rows.columns if c != "text"]
    schema = rows.select(*kept).withColumn("fp", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            fp = fingerprints(batch.column("text").cast(pa.binary()).to_pylist(), width)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(fp.view(np.int64))], names=[*kept, "fp"])

    return rows.mapInArrow(run, schema)


def groups(prints: DataFrame, least: Column, radius: int = RADIUS) -> DataFrame:
    """``(fp, least)``: for each fingerprint the minimum of ``least`` over all rows that can be reached from it."""
    own = table(prints.groupBy("fp").agg(F.min(least).alias("own")), "prints")
    found = components(table(links(own.select("fp"), radius), "links"))
    rooted = table(own.join(found.select(F.col("node").alias("fp"), "component"), "fp", "left").select("fp", "own", F.coalesce("component", "fp").alias("root")), "roots")
    of = rooted.groupBy("root").agg(F.min("own").alias("least"))
    return table(rooted.select("fp", "root").join(of, "root").select("fp", "least"), "groups")


def near_copies(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``: the fingerprint as 16 hex digits, and the least ``doc_id``
    among all texts that a chain of links reaches.

    A to Z are lower-cased; texts with fewer words than a shingle hash as one; null texts and texts
    without a word have fingerprint zero and are linked like any other. Null ids do not count for the
    minimum, which is null only if all ids of a group are. Repeated rows stay. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prints = table(prints_of(rows, width), "fingerprints")
    return prints.join(groups(prints, F.col("doc_id"), radius), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least").alias("component_id")
    )
