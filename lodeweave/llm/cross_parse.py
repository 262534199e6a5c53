"""Language of a text by cross-parsing (Ziv and Merhav 1993).

A suffix automaton holds all substrings of a language's training text. A text is cut greedily into
phrases, each the longest match from where the last one ended; the language that needs the fewest
phrases, times the bits that name one in its training text, wins.

The training text of a language is bounded: ``DOCS`` documents, ``LETTERS`` characters in all. Prediction
reads whole texts. Texts are cut into blocks of ``BLOCK`` characters, a phrase ends with its block, and
all blocks of a batch are parsed in step by numpy, in all languages at once: the automaton is a table in
which a missing transition already leads to the start of the next phrase and counts it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeweave.llm.common import pieces, table

# Bounds of the labelled sample per language.
DOCS = 200
LETTERS = 60_000
BLOCK = 512
UNKNOWN = "und"


def automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of ``text`` (Blumer et al. 1985); state 0 is the start."""
    go: list[dict[int, int]] = [{}]
    link, size = [-1], [0]
    last = 0
    for c in text:
        new = len(go)
        go.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if size[p] + 1 == size[q]:
                link[new] = q
            else:
                twin = len(go)
                go.append(dict(go[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return go


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


class Parser:
    """Tables for the languages of a training sample ``{lang: [texts]}``."""

    _built: dict[int, Parser] = {}

    @classmethod
    def of(cls, sample: dict[str, list[str]]) -> Parser:
        key = hash(tuple((k, tuple(v)) for k, v in sorted(sample.items())))
        if key not in cls._built:
            cls._built.clear()
            cls._built[key] = cls(sample)
        return cls._built[key]

    def __init__(self, sample: dict[str, list[str]]):
        self.langs = sorted(sample)
        seen = sorted({c for texts in sample.values() for t in texts for c in t.lower() if c.isalpha()})
        # 0: a space, 1: a letter outside the training text, then its letters, then the padding
        self.pad = len(seen) + 2
        self.classes = np.zeros(0x110000, np.int16)
        self.classes[:] = _letters()
        for k, c in enumerate(seen):
            self.classes[ord(c)] = k + 2
        width = self.pad + 1
        tables, base = [], 0
        self.start, self.bits = [], []
        for lang in self.langs:
            text: list[int] = []
            for t in sample[lang]:
                if len(text) >= LETTERS:
                    break
                text += self.squeeze(t)[0][: LETTERS - len(text)].tolist() + [0, 0]
            go = automaton(text)
            state = np.repeat(np.arange(len(go)), [len(g) for g in go])
            char = np.array([c for g in go for c in g], np.int64)
            to = np.array([s for g in go for s in g.values()], np.int64)
            full = np.zeros((len(go), width), np.int64)
            # A phrase that ends here: the character starts the next one, if it starts any.
            first = np.zeros(width, np.int64)
            first[char[state == 0]] = to[state == 0]
            full[:] = (base + first * width) * 2 + 1
            known = state > 0
            full[state[known], char[known]] = (base + to[known] * width) * 2
            full[:, self.pad] = (base + np.arange(len(go)) * width) * 2
            tables.append(full.astype(np.int32).ravel())
            self.start.append(base)
            self.bits.append(math.log2(max(len(text), 2)))
            base += len(go) * width
        self.table = np.concatenate(tables) if tables else np.zeros(0, np.int32)

    def squeeze(self, text: str) -> tuple[np.ndarray, bool]:
        """Classes of the characters, lower-cased, every stretch without a letter as one space, and
        whether there is a letter."""
        c = self.classes[_codes(text.lower())]
        c = c[np.concatenate(([True], (c[1:] != 0) | (c[:-1] != 0)))] if len(c) else c
        return c, bool(c.any())

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        squeezed = [self.squeeze(t or "") for t in texts]
        sizes = np.array([len(c) if ok else 0 for c, ok in squeezed], np.int64)
        blocks = -(-sizes // BLOCK)
        n = int(blocks.sum())
        if not n or not self.langs:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        chars = np.full((n, BLOCK), self.pad, np.int32)
        flat = chars.ravel()
        for (c, ok), at in zip(squeezed, (np.cumsum(blocks) - blocks) * BLOCK):
            if ok:
                flat[at : at + len(c)] = c
        length = np.minimum(BLOCK, np.concatenate([np.maximum(s - np.arange(b) * BLOCK, 0) for s, b in zip(sizes, blocks)]))
        # Longest blocks first, so that a step looks only at blocks that still run.
        order = np.argsort(-length, kind="stable")
        chars = np.ascontiguousarray(chars[order].T)
        running = np.searchsorted(-length[order], -np.arange(BLOCK), side="left")
        count = np.zeros((len(self.langs), n), np.int32)
        state = np.repeat(np.array(self.start, np.int32)[:, None], n, axis=1)
        for t in range(int(length.max())):
            k = int(running[t])
            v = self.table.take(state[:, :k] + chars[t, :k])
            count[:, :k] += v & 1
            state[:, :k] = v >> 1
        per_block = np.empty_like(count)
        per_block[:, order] = count
        has = np.flatnonzero(blocks)
        phrases = np.add.reduceat(per_block, (np.cumsum(blocks) - blocks)[has], axis=1)
        cost = phrases * np.array(self.bits)[:, None]
        best = cost.argmin(axis=0)
        share = 1 / np.exp2(-np.minimum(cost - cost.min(axis=0), 1000)).sum(axis=0)
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        for k, b, s in zip(has.tolist(), best.tolist(), share.tolist()):
            langs[k], scores[k] = self.langs[b], float(s)
        return langs, scores


def _letters() -> np.ndarray:
    """1 for letters, 0 for all other code points."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), np.int16, 0x110000)


def training_sample(labelled: DataFrame, docs: int = DOCS) -> dict[str, list[str]]:
    """At most ``docs`` texts per language, chosen by the hash of the text; each gives an equal part of the
    ``LETTERS`` that a language may use, more if there are fewer texts."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), "text")
    order = W.partitionBy("lang").orderBy("place", "text")
    # Texts that cannot be among the first are left out before the sort: the share of the hashes that holds four
    # times as many is enough.
    share = table(rows.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(4.0 * docs) / F.count("*")).alias("share")), "languages")
    picked = (
        rows.select("lang", F.pmod(F.xxhash64("text"), F.lit(1 << 40)).alias("place"), F.substring(F.col("text").cast("string"), 1, 4 * LETTERS // docs).alias("text"))
        .join(share, "lang")
        .where(F.col("place") <= F.col("share") * (1 << 40))
        .withColumn("k", F.row_number().over(order))
        .where(F.col("k") <= docs)
    )
    out: dict[str, list[str]] = {}
    for r in picked.sort("lang", "k").collect():
        out.setdefault(r["lang"], []).append(r["text"])
    return out


def predict_language(docs: DataFrame, sample: dict[str, list[str]], *keep: str) -> DataFrame:
    """The columns ``keep`` of ``docs``, ``lang_pred`` and ``score`` (the winner's share when each language
    weighs two to the power of minus its cost).

    Null texts and texts without a letter are ``und`` with score 0, as are all if nothing was learned; equal
    costs go to the first language in order. Only ``text`` is read for a prediction.
    """
    rows = docs.select(*keep, F.col("text").cast("string").alias("text"))
    schema = rows.drop("text").withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser.of(sample)
        for batch in pieces(batches, "text"):
            langs, scores = parser.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])

    return rows.mapInArrow(run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` of every row, learned from the labelled rows that are not held
    out: those whose crc32 of the id leaves 0 or 2 when divided by 3. A null id is neither."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang")).withColumn("rest", F.crc32(F.col("doc_id").cast("string")) % 3)
    sample = training_sample(rows.where("rest <> 1"))
    return predict_language(rows.withColumn("held_out", F.coalesce(F.col("rest") == 1, F.lit(False))), sample, "doc_id", "held_out")
