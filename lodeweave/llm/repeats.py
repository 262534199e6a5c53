"""Removal of long passages that occur more than once, by recompression.

Recompression (Jez 2015) shortens all texts together in rounds: one round names runs of an equal
token, the next ones name pairs of neighbours, where a bit of each name says whether it may only be
the left or only the right half of a pair. Names here are 64-bit mixes of the names below them, so
they are global without a table of names and a round needs no shuffle. A symbol is fixed by a few
words around it; ``lo`` and ``hi`` carry those words' bounds through the rounds. Where these bounds
lie inside a window, every equal window has the same symbol at the same place.

So a window can only repeat if every symbol fixed inside it occurs twice (*shared*). Spark counts the
symbols, a second pass keeps the windows that pass this test, and those are compared by 96 bits of
their words' hashes. Both counts use the same job, ``_repeated``:

- a task folds the copies that it holds itself, so a key that fills a third of the corpus reaches
  its reducer once a batch;
- keys travel as packed arrays by range of the key, and what is repeated returns as packed positions
  by block of documents. Both are spread by hash; no task holds the corpus.

Texts, not ids, decide: rows are followed by (hash of id and text, id), so null or repeated ids are safe.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.llm.common import flat_words, mix, partitions, pieces, table

WINDOW = 35
# Pair rounds. With 6 a symbol spans about 5 words and is fixed by about 17, half a window.
ROUNDS = 6
_BASE = 0x9E3779B97F4A7C15 | 1
_GROUPS = "bucket int, kind int, rid binary, did binary, n binary, pos binary, k1 binary, k2 binary"
_MARKS = "block int, rid binary, did binary, n binary, pos binary"


def _powers(n: int, cache: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    if n > cache.get("n", 0):
        size = max(n, 1 << 20)
        up, down = np.full(size, np.uint64(_BASE)), np.full(size, np.uint64(pow(_BASE, -1, 1 << 64)))
        up[0] = down[0] = 1
        cache.update(n=size, up=np.cumprod(up), down=np.cumprod(down))
    return cache["up"][:n], cache["down"][:n]


class Laid:
    """The words of a batch in one row, a separator before each text."""

    def __init__(self, texts: pa.Array):
        flat, self.counts = flat_words(texts)
        coded = flat.dictionary_encode()
        distinct = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)
        names = b"".join(map(xxhash.xxh3_128_digest, distinct))
        names = np.frombuffer(names, "<u8").reshape(-1, 2)
        docs = len(self.counts)
        #: place of each text's separator; its words follow
        self.start = np.concatenate(([0], np.cumsum(self.counts + 1)))
        self.n = int(self.start[-1])
        self.doc = np.repeat(np.arange(docs, dtype=np.int32), self.counts + 1)
        self.real = np.ones(self.n, bool)
        self.real[self.start[:-1]] = False
        codes = coded.indices.to_numpy()
        self.h = np.zeros((2, self.n), np.uint64)
        self.h[:, self.real] = names[codes].T if len(codes) else 0
        up, self.down = _powers(self.n + 1)
        self.sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * up[: self.n]))) for h in self.h]

    def key(self, lo: np.ndarray, hi: np.ndarray, lane: int = 0) -> np.ndarray:
        """Hash of the words lo to hi - 1, for any number of such passages."""
        c = self.sums[lane]
        return mix((c[hi] - c[lo]) * self.down[lo] + (hi - lo).astype(np.uint64))

    def windows(self, width: int) -> np.ndarray:
        """Places at which a whole window starts."""
        ends = np.zeros(self.n, bool)
        room = self.start[1:][self.doc] - np.arange(self.n)
        ends[:] = self.real & (room >= width)
        return np.flatnonzero(ends)

    def symbols(self, rounds: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(lo, hi) of the symbols of the last round that at most ``width`` words fix, each once."""
        name, real = self.h[0], self.real
        at = np.arange(self.n)
        if not self.n:
            return at, at
        # Runs of a token get one name. That a run ends is seen from its neighbours.
        first = np.concatenate(([True], (name[1:] != name[:-1]) | ~real[1:] | ~real[:-1]))
        head = np.flatnonzero(first)
        tail = np.concatenate((head[1:], [self.n]))
        length = (tail - head).astype(np.uint64)
        name, real = np.where(length > 1, mix(name[head] + length * np.uint64(_BASE)), name[head]), real[head]
        lo, hi = head - 1, tail + 1
        for k in range(rounds):
            bit = (mix(name + np.uint64((k + 1) * _BASE % (1 << 64))) >> np.uint64(63)).astype(bool)
            left, right = real & ~bit, real & bit
            pair = np.zeros(len(name), bool)
            pair[:-1] = left[:-1] & right[1:]
            second = np.concatenate(([False], pair[:-1]))
            # A symbol that stays single is so because of the neighbour it could have joined.
            new_lo, new_hi = lo.copy(), hi.copy()
            lone = np.flatnonzero(right & ~second)
            new_lo[lone] = lo[np.maximum(lone - 1, 0)]
            lone = np.flatnonzero(left)
            new_hi[lone] = hi[np.minimum(lone + 1, len(hi) - 1)]
            joined = name.copy()
            where = np.flatnonzero(pair)
            joined[where] = mix(name[where] * np.uint64(3) + mix(name[where + 1]))
            new_hi[where] = hi[where + 1]
            keep = ~second
            name, real, lo, hi = joined[keep], real[keep], new_lo[keep], new_hi[keep]
        good = real & (hi - lo <= width)
        lo, hi = lo[good], hi[good]
        inside = (lo > self.start[self.doc[lo]]) & (hi <= self.start[self.doc[lo] + 1])
        lo, hi = lo[inside], hi[inside]
        new = np.ones(len(lo), bool)
        new[1:] = (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
        return lo[new], hi[new]

    def local(self, at: np.ndarray) -> np.ndarray:
        return (at - self.start[self.doc[at]] - 1).astype(np.uint32)


def _grouped(group: np.ndarray, doc: np.ndarray, rid: np.ndarray, did: np.ndarray, *rest: np.ndarray):
    """Rows of each group: its documents with their numbers of entries, and the entries' values, packed."""
    order = np.argsort(group, kind="stable")
    group, doc, rest = group[order], doc[order], [r[order] for r in rest]
    cuts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(group) else []
    for a, b in zip(cuts, [*cuts[1:], len(group)]):
        d = doc[a:b]
        new = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
        n = np.diff(np.concatenate((new, [b - a]))).astype(np.uint32)
        of = d[new]
        yield int(group[a]), rid[of].tobytes(), did[of].tobytes(), n.tobytes(), *(r[a:b].tobytes() for r in rest)


def _block(rid: np.ndarray, n: int) -> np.ndarray:
    return ((mix(rid.view(np.uint64)) >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int32)


def _bucket(key: np.ndarray, n: int) -> np.ndarray:
    return ((key >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int32)


def _copies(k1: np.ndarray, k2: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key occurs again (or is ``known`` to); the index of one row of each distinct key."""
    if not len(k1):
        return np.zeros(0, bool), np.zeros(0, np.int64)
    order = np.argsort(k1)
    if bool(((k1[order][1:] == k1[order][:-1]) & (k2[order][1:] != k2[order][:-1])).any()):
        order = np.lexsort((k2, k1))
    a, b = k1[order], k2[order]
    head = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    at = np.flatnonzero(head)
    many = np.diff(np.concatenate((at, [len(a)]))) > 1
    if known is not None:
        many |= np.logical_or.reduceat(known[order], at)
    flag = np.zeros(len(a), bool)
    flag[order] = np.repeat(many, np.diff(np.concatenate((at, [len(a)]))))
    return flag, order[at]


def _send(laid: Laid, rid, did, at: np.ndarray, k1: np.ndarray, k2: np.ndarray, n: int, extra: np.ndarray) -> pa.RecordBatch:
    """Keys of a batch by bucket. Copies within the batch are marked at once (kind 1), and one such
    key goes on (kind 2); keys met once go with their place (kind 0). ``extra``: places to mark anyway."""
    rows = {c: [] for c in ("bucket", "kind", "rid", "did", "n", "pos", "k1", "k2")}

    def add(kind: int, packed) -> None:
        for row in packed:
            for c, v in zip(("bucket", "rid", "did", "n", "pos", "k1", "k2"), (*row, *[b""] * (7 - len(row)))):
                rows[c].append(v)
            rows["kind"].append(kind)

    doc = laid.doc
    many, one = _copies(k1, k2)
    alone = np.flatnonzero(~many)
    add(0, _grouped(_bucket(k1[alone], n), doc[at[alone]], rid, did, laid.local(at[alone]), k1[alone], k2[alone]))
    marked = np.sort(np.concatenate((at[many], extra)))
    add(1, _grouped(_block(rid, n)[doc[marked]], doc[marked], rid, did, laid.local(marked)))
    lead = one[many[one]]
    for b, _, _, _, x, y in _grouped(_bucket(k1[lead], n), np.zeros(len(lead), np.int32), rid, did, k1[lead], k2[lead]):
        add(2, [(b, b"", b"", b"", b"", x, y)])
    types = {"bucket": pa.int32(), "kind": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array(v, types.get(c, pa.binary())) for c, v in rows.items()], names=list(rows))


def _cat(column, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype)


def _meet(n: int):
    def meet(group: pa.Table) -> pa.Table:
        kind = group["kind"].to_numpy()
        alone, lead = group.filter(pa.array(kind == 0)), group.filter(pa.array(kind == 2))
        k1 = np.concatenate((_cat(alone["k1"], np.uint64), _cat(lead["k1"], np.uint64)))
        k2 = np.concatenate((_cat(alone["k2"], np.uint32), _cat(lead["k2"], np.uint32)))
        counts, pos = _cat(alone["n"], np.uint32), _cat(alone["pos"], np.uint32)
        rid, did = _cat(alone["rid"], np.int64), _cat(alone["did"], np.int64)
        many, _ = _copies(k1, k2, np.arange(len(k1)) >= len(pos))
        hit = many[: len(pos)]
        doc = np.repeat(np.arange(len(counts)), counts)[hit]
        out = list(_grouped(_block(rid, n)[doc], doc, rid, did, pos[hit])) if hit.any() else []
        passed = group.filter(pa.array(kind == 1)).select(["bucket", "rid", "did", "n", "pos"])
        cols = [[*passed.column(i).to_pylist(), *(r[i] for r in out)] for i in range(5)]
        return pa.table([pa.array(c, pa.int32() if i == 0 else pa.binary()) for i, c in enumerate(cols)], names=["block", "rid", "did", "n", "pos"])

    return meet


def _gather(group: pa.Table) -> pa.Table:
    n, pos = _cat(group["n"], np.uint32), _cat(group["pos"], np.uint32)
    rid, did = np.repeat(_cat(group["rid"], np.int64), n), np.repeat(_cat(group["did"], np.int64), n)
    order = np.lexsort((pos, did, rid))
    rid, did, pos = rid[order], did[order], pos[order]
    head = np.flatnonzero(np.concatenate(([True], (rid[1:] != rid[:-1]) | (did[1:] != did[:-1])))) if len(rid) else np.zeros(0, int)
    ends = [*head[1:], len(rid)]
    return pa.table(
        [pa.array(rid[head]), pa.array(did[head]), pa.array([pos[a:b].tobytes() for a, b in zip(head, ends)], pa.binary())],
        names=["rid", "did", "at"],
    )


def _repeated(sent: DataFrame, n: int, name: str) -> DataFrame:
    """``(rid, did, at)``: for each text the places whose key occurs again, as packed uint32."""
    marks = sent.groupBy("bucket").applyInArrow(_meet(n), _MARKS)
    return table(marks.groupBy("block").applyInArrow(_gather, "rid long, did long, at binary"), name)


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column("rid").to_numpy(), batch.column("did").to_numpy()


def _send_symbols(width: int, rounds: int, n: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            laid = Laid(batch.column("text"))
            rid, did = _columns(batch)
            lo, hi = laid.symbols(rounds, width)
            # Windows in which no symbol is fixed are kept for the comparison: place 0 is marked for their text.
            at = laid.windows(width)
            bare = laid.start[:-1][np.unique(laid.doc[at[~_any_inside(laid, at, lo, hi, width)]])] + 1
            yield _send(laid, rid, did, lo, laid.key(lo, hi), np.zeros(len(lo), np.uint32), n, bare)

    return send


def _any_inside(laid: Laid, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, width: int) -> np.ndarray:
    """Whether a window from ``at`` holds a passage (lo, hi) whole: both bounds rise together, so
    the first passage from ``at`` on decides."""
    if not len(lo):
        return np.zeros(len(at), bool)
    first = np.searchsorted(lo, at)
    ok = first < len(lo)
    return ok & (hi[np.minimum(first, len(hi) - 1)] <= at + width)


def _send_windows(width: int, rounds: int, n: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            laid = Laid(batch.column("text"))
            rid, did = _columns(batch)
            lo, hi = laid.symbols(rounds, width)
            shared = np.zeros(laid.n, bool)
            marks = batch.column("at").to_pylist()
            counts = np.array([len(m) // 4 for m in marks])
            shared[np.repeat(laid.start[:-1], counts) + 1 + np.frombuffer(b"".join(marks), np.uint32).astype(np.int64)] = True
            # Symbols fixed from the same place on share a mark; a symbol that is not shared may so pass
            # for one that is, which costs a comparison and loses none.
            new = ~shared[lo]
            at = laid.windows(width)
            at = at[~_any_inside(laid, at, lo[new], hi[new], width)]
            end = at + width
            yield _send(laid, rid, did, at, laid.key(at, end), (laid.key(at, end, 1) >> np.uint64(32)).astype(np.uint32), n, at[:0])

    return send


def _finish(width: int):
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, shas, kept_texts = [], [], [], []
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for text, at in zip(texts, batch.column("at").to_pylist()):
                found = (text or b"").split()
                total.append(len(found))
                if at:
                    starts = np.frombuffer(at, np.uint32).astype(np.int64)
                    edge = np.zeros(len(found) + 1, np.int32)
                    np.add.at(edge, starts, 1)
                    np.add.at(edge, starts + width, -1)
                    free = np.cumsum(edge[:-1]) == 0
                    found = [w for w, k in zip(found, free.tolist()) if k]
                gone.append(total[-1] - len(found))
                kept_texts.append(b" ".join(found))
                shas.append(hashlib.sha256(kept_texts[-1]).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(shas, pa.string()), pa.array(kept_texts, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
            )

    return finish


def repeated_windows(docs: DataFrame, width: int = WINDOW, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, text, rid, did) and ``(rid, did, at)``, the places of their repeated windows."""
    # As many buckets and blocks as shuffle partitions: a bucket answers each block in one row.
    n = min(partitions(docs.sparkSession), 60_000)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.xxhash64("doc_id", "text").alias("rid"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("did"),
    )
    symbols = rows.select("rid", "did", "text").mapInArrow(_send_symbols(width, rounds, n), _GROUPS)
    shared = _repeated(symbols, n, "symbols")
    # An identical row (same id, same text) has the same places, so one row of marks serves both.
    windows = rows.select("rid", "did", "text").join(shared, ["rid", "did"]).mapInArrow(_send_windows(width, rounds, n), _GROUPS)
    return rows, _repeated(windows, n, "windows")


def remove_repeats(docs: DataFrame, width: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256, kept_text)``: each text without the words that lie in
    a window of ``width`` words found twice or more in the table, the same text included.

    Null or empty texts have no words; texts shorter than a window keep all. Every copy of a repeated
    passage goes, the first too. Rows repeated in the table are two texts. Other columns are ignored.
    """
    rows, found = repeated_windows(docs, width, rounds)
    return (
        rows.join(found, ["rid", "did"], "left")
        .select("doc_id", "text", "at")
        .mapInArrow(_finish(width), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    )
