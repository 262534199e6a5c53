"""BPE encoding and decoding through a table of distinct words.

1. Texts are split into words by Spark's own functions. The vocabulary file states its normaliser and its pattern; below
   U+0300 the normaliser only lower-cases, so Java's regular expressions give the library's words. Texts with other
   characters, or with the string of an added token, are normalised and split by the library inside the task.
2. Neighbouring texts form a block. A block keeps its words as positions into a list of its distinct words; the list is
   cut into parts by the hash of the word.
3. The lists are dealt by part, once. Of all lists of a part, each distinct word is encoded once, and a join on the word brings
   its ids back to every list it stands in, where the part lies; only the table of distinct words is shuffled once more. A word stands once in a block's list, however often it stands in
   the texts, so the most frequent word takes no more of a part than there are blocks.
4. The ids that a block uses are joined with the table of pieces.
5. Lists and pieces return to their block, where the positions pick the ids of each text in order, and the ids its pieces.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.llm.common import _setting, partitions, table
from lodeweave.session import new_path, pin, unpin
from lodeweave.sources.index import write_bucketed

# Words in a block; a longer text is a block of its own. The larger a block, the fewer distinct words it has for its size.
BLOCK_WORDS = 8_000_000
# Words of a block whose texts are put together at a time.
SLICE_WORDS = 1_000_000
# Below U+0300 no character combines with another; U+0130 is the one whose lower case does.
PLAIN = r"\u0000-įı-˿"
# The only normaliser, and the only way to split, that step 1 covers.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
CO_PARTITION = "spark.sql.requireAllClusterKeysForCoPartition"

_BLOCKS = "block long, doc_ids array<long>, counts array<long>, codes binary, lists array<struct<part:int,start:int,words:string>>"

_ANSWERS = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids_text", "decoded"]


class Vocabulary:
    """What the file says, read once in each worker."""

    _read: dict[str, Vocabulary] = {}

    @classmethod
    def at(cls, path: str) -> Vocabulary:
        if path not in cls._read:
            cls._read[path] = cls(path)
        return cls._read[path]

    def __init__(self, path: str):
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if spec["normalizer"].get("normalizers") != NORMALIZER or split["behavior"] != "Removed" or not split["invert"] or spec["decoder"] is not None:
            raise ValueError(f"{path} is no word BPE file with the rules known here")
        self.pattern: str = split["pattern"]["Regex"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in spec["added_tokens"]):
            raise ValueError(f"{path} has added tokens with rules not known here")
        self.library = Tokenizer.from_file(path)
        self.words_of = pre_tokenizers.Split(Regex(self.pattern), "removed", invert=True)
        self.bytes_of = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.specials = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None

    def split(self, text: str) -> list[str]:
        """Words as the library makes them; the string of an added token is a word."""
        out: list[str] = []
        for part in self.specials.split(text) if self.specials else [text]:
            if part in self.added:
                out.append(part)
            elif part:
                out += [w for w, _ in self.words_of.pre_tokenize_str(self.library.normalizer.normalize_str(part))]
        return out

    def ids(self, word: str) -> list[int]:
        if word in self.added:
            return [self.added[word]]
        return [t.id for mapped, _ in self.bytes_of.pre_tokenize_str(word) for t in self.library.model.tokenize(mapped)]

    def pieces(self) -> list[tuple[int, str]]:
        return [(i, p) for p, i in self.library.get_vocab(with_added_tokens=True).items()]


def _java(pattern: str) -> str:
    """The pattern for Java, whose \\s knows ASCII only."""
    return pattern.replace(r"[^\s", r"[^\s\x{85}\x{A0}")


def _native(text: Column, vocabulary: Vocabulary) -> tuple[Column, Column]:
    """(whether the library must split the text, the words of other texts)."""
    hard = text.rlike(f"[^{PLAIN}]")
    for s in vocabulary.added:
        hard = hard | text.contains(s)
    found = F.regexp_extract_all(F.lower(text), F.lit(_java(vocabulary.pattern)), F.lit(0))
    return hard, F.when(~hard, found)


def _blocks(path: str, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.at(path)
        block = TaskContext.get().partitionId() << 36
        for batch in batches:
            ids, hard, found = (batch.column(k) for k in range(3))
            if hard.null_count < len(hard):
                told = [vocabulary.split(t) if t is not None else w for t, w in zip(hard.to_pylist(), found.to_pylist())]
                found = pa.array(told, pa.large_list(pa.large_string()))
            counts = pc.fill_null(pc.list_value_length(found), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(counts)
            at = 0
            while at < len(ends):
                base = ends[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(ends, base + BLOCK_WORDS, side="right")))
                yield _block(block, ids.slice(at, to - at), counts[at:to], found.slice(at, to - at).flatten(), parts)
                block += 1
                at = to
            del ids, hard, found, batch
            pa.default_memory_pool().release_unused()

    return run


def _block(block: int, ids: pa.Array, counts: np.ndarray, flat: pa.Array, parts: int) -> pa.RecordBatch:
    coded = flat.cast(pa.large_string()).dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    part = np.fromiter((zlib.crc32(w.encode()) % parts for w in distinct), np.int64, len(distinct))
    order = np.argsort(part, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    heads = np.flatnonzero(np.concatenate(([True], np.diff(part[order]) > 0))) if len(order) else np.zeros(0, np.int64)
    tails = np.concatenate((heads[1:], [len(order)])) if len(order) else heads
    lists = [{"part": int(part[order[a]]), "start": int(a), "words": " ".join([distinct[i] for i in order[a:b]])} for a, b in zip(heads, tails)]
    packed = _pack(coded.indices.to_numpy(zero_copy_only=False), place)
    return pa.RecordBatch.from_pydict(
        {
            "block": pa.array([block], pa.int64()),
            "doc_ids": pa.array([ids.to_pylist()], pa.list_(pa.int64())),
            "counts": pa.array([counts.tolist()], pa.list_(pa.int64())),
            "codes": pa.array([packed], pa.binary()),
            "lists": pa.array([lists], pa.list_(pa.struct([("part", pa.int32()), ("start", pa.int32()), ("words", pa.string())]))),
        }
    )


def _planes(values: np.ndarray) -> bytes:
    """Whole numbers byte by byte: first all low bytes, last all high ones, which are nearly all zero."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplanes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _pack(codes: np.ndarray, place: np.ndarray) -> bytes:
    """Codes numbered by frequency, which compresses well, and the place in the lists of each number."""
    by_count = np.argsort(-np.bincount(codes, minlength=len(place)), kind="stable")
    number = np.empty(len(place), np.int64)
    number[by_count] = np.arange(len(place))
    raw = _planes(place[by_count]) + _planes(number[codes])
    return len(place).to_bytes(8, "little") + len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=3).compress(raw, asbytes=True)


def _unpack(packed: bytes) -> np.ndarray:
    """The place in the lists of each word of the block."""
    n, size = int.from_bytes(packed[:8], "little"), int.from_bytes(packed[8:16], "little")
    raw = pa.Codec("zstd").decompress(packed[16:], size, asbytes=True) if size else b""
    return _unplanes(raw[: 4 * n])[_unplanes(raw[4 * n :])]


def split_blocks(docs: DataFrame, path: str, parts: int) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    hard, found = _native(F.col("t"), Vocabulary.at(path))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("t"))
    return rows.select("doc_id", F.when(hard, F.col("t")).alias("hard"), found.alias("words")).mapInArrow(_blocks(path, parts), _BLOCKS)


def encode_words(words: DataFrame, path: str) -> DataFrame:
    """``words`` with their ``ids``; each row is encoded once."""

    @F.arrow_udf("array<int>")
    def ids(word: pa.Array) -> pa.Array:
        vocabulary = Vocabulary.at(path)
        return pa.array([vocabulary.ids(w) for w in word.to_pylist()], pa.list_(pa.int32()))

    return words.withColumn("ids", ids("word"))


def with_pieces(ids: DataFrame, path: str) -> DataFrame:
    """Rows with an ``id`` joined with its ``piece``, null for ids outside the vocabulary. The table of pieces has as many rows as
    the vocabulary, whatever the input, and goes to all tasks."""
    pieces = ids.sparkSession.createDataFrame(Vocabulary.at(path).pieces(), "id int, piece string")
    return ids.join(F.broadcast(pieces), "id", "left")


def decode(rows: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """``(keys, decoded)`` of rows ``(keys, ids)``: each id is joined with its piece, and the pieces of a key are put
    together in order with spaces between them, as the library's decode does without a decoder. Keys must differ from row to
    row, and be short, as every id carries them; rows without ids have the empty text; ids outside the vocabulary have no
    piece."""
    placed = with_pieces(rows.select(*keys, F.posexplode_outer("ids").alias("at", "id")), path)
    held = F.when(F.col("piece").isNotNull(), F.struct("at", "piece"))
    return placed.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(held)), lambda x: x["piece"]), " ").alias("decoded"))


def _key(word: Column) -> Column:
    """A short name for a word: itself, or its hash behind a space, which no word holds."""
    return F.when(F.octet_length(word) <= 64, word).otherwise(F.concat(F.lit(" "), F.sha2(word, 256)))


def _answers(blocks: pa.Table, lists: pa.Table, whole: bool) -> pa.Table:
    """The texts of one block, from the ids of its distinct words and the pieces of its ids."""
    out: list[list] = [[] for _ in range(6 if whole else 4)]
    if blocks.num_rows:
        words, pieces = _word_ids(lists), _pieces_by_id(lists)
        ids = words.flatten()
        tokens = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        told = pc.binary_join_element_wise(ids.cast(pa.string()), "", " ").cast(pa.large_string())
        codes = _unpack(blocks.column("codes")[0].as_py())
        counts = np.array(blocks.column("counts")[0].as_py(), np.int64)
        ends = np.concatenate(([0], np.cumsum(counts)))
        starts = np.concatenate(([0], np.cumsum(tokens)))[:-1]
        out[0] = blocks.column("doc_ids")[0].as_py()
        at = 0
        while at < len(counts):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE_WORDS, side="right")) - 1)
            here = codes[ends[at] : ends[to]]
            n = tokens[here]
            # The place of each token of these texts among the ids of the block's words.
            sums = np.concatenate(([0], np.cumsum(n)))
            place = np.arange(sums[-1]) + np.repeat(starts[here] - sums[:-1], n)
            cuts = sums[ends[at : to + 1] - ends[at]]
            out[1] += np.diff(cuts).tolist()
            taken = ids.take(pa.array(place))
            for column, parts in ((2, told.take(pa.array(place))), (3, pieces.take(taken))):
                texts = _joined(parts, cuts)
                out[column] += [hashlib.sha256(t).hexdigest() for t in texts]
                if whole:
                    out[column + 2] += [t.decode() for t in texts]
            at = to
        del words, pieces, ids, told, codes
        pa.default_memory_pool().release_unused()
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
    return pa.table([pa.array(c, t) for c, t in zip(out, types)], _ANSWERS[: len(out)])


def _word_ids(lists: pa.Table) -> pa.ListArray:
    """The ids of each word of the block, in the order of its lists."""
    rows = lists.filter(pc.greater_equal(lists.column("start"), 0)).sort_by("start")
    words = pa.array([w for one in rows.column("ids").to_pylist() for w in one.split("\n")], pa.string())
    split = pc.split_pattern(words, " ")
    return pa.ListArray.from_arrays(split.offsets, split.flatten().cast(pa.int32()))


def _pieces_by_id(lists: pa.Table) -> pa.Array:
    """The piece of each id with a space behind it; ids that the block does not use are empty."""
    (row,) = lists.filter(pc.less(lists.column("start"), 0)).column("pieces").to_pylist() or [[]]
    out = [""] * (1 + max((p["id"] for p in row), default=-1))
    for p in row:
        out[p["id"]] = p["piece"] + " "
    return pa.array(out, pa.large_string())


def _joined(words: pa.Array, ends: np.ndarray) -> list[bytes]:
    """The words between neighbouring ``ends`` in one text; each word brings the space after it."""
    buffers = words.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, len(words) + 1, words.offset * 8)[ends] if len(words) else ends
    data = memoryview(buffers[2]) if buffers[2] is not None else memoryview(b"")
    return [bytes(data[a : max(a, b - 1)]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def encode(docs: DataFrame, path: str, whole: bool = True) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256, ids_text, decoded)`` of each text of ``(doc_id, text)``, as the library
    encodes it without further tokens and decodes it with all of them; ``ids_text`` are the ids with spaces between.
    Without ``whole`` the last two columns, which are larger than the texts, are left out.

    Null and empty texts have no ids and decode to the empty text. Every row has an answer of its own, so repeated rows
    and null ids do not matter; other columns are not read. An empty table has no rows. Words may have any length.
    """
    spark = docs.sparkSession
    parts = partitions(spark)
    # Stored by block, so the positions, the largest part of all, never move again.
    name = f"blocks_{uuid.uuid4().hex}"
    blocks = write_bucketed(split_blocks(docs, path, parts), name, ["block"], parts, new_path(spark, "blocks"))
    # Dealt once; the checkpoint keeps the layout, so that what follows needs no shuffle.
    dealt = pin(blocks.select("block", F.inline("lists")).repartition(parts, "part"))
    listed = dealt.select("part", "block", "start", F.posexplode(F.split("words", " ")).alias("at", "word")).withColumn("key", _key(F.col("word")))
    with _setting(spark, CO_PARTITION, "false"):
        # Spark forgets the layout behind a Python function, so the ids of the distinct words are dealt again.
        encoded = encode_words(listed.select("part", "key", "word").distinct(), path).drop("word").repartition(parts, "part")
        ids = F.array_join(F.transform("ids", lambda i: i.cast("string")), " ").alias("ids")
        told = (
            listed.drop("word")
            .hint("merge")
            .join(encoded.select("part", "key", ids), ["part", "key"])
            .groupBy("part", "block", "start")
            .agg(F.sort_array(F.collect_list(F.struct("at", "ids"))).alias("w"))
            .select("block", "start", F.array_join(F.transform("w", lambda x: x["ids"]), "\n").alias("ids"))
        )
        told = table(told, "lists")
    unpin(dealt)
    used = told.select("block", F.explode(F.split(F.translate("ids", "\n", " "), " ")).alias("id")).select("block", F.col("id").cast("int").alias("id"))
    pieces = with_pieces(used.distinct(), path).groupBy("block").agg(F.collect_list(F.struct("id", "piece")).alias("pieces"))
    lists = told.withColumn("pieces", F.lit(None).cast("array<struct<id:int,piece:string>>")).unionByName(
        pieces.select("block", F.lit(-1).alias("start"), F.lit(None).cast("string").alias("ids"), "pieces")
    )
    texts = blocks.select("block", "doc_ids", "counts", "codes")
    answer = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids_text string, decoded string" if whole else "")
    return texts.groupBy("block").cogroup(lists.groupBy("block")).applyInArrow(lambda b, w: _answers(b, w, whole), answer)
