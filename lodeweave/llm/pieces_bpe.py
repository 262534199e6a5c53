"""SentencePiece encoding and decoding by vectorised merge rounds.

The words of a batch (a word starts at a space mark that follows another character; no piece crosses
such a place, which is checked when the model is read) are laid out in flat numpy arrays of symbols. In
each round every word finds the best rank among its neighbouring pairs with a segmented minimum,
merges its leftmost pair of that rank, and the arrays are compacted; words without a pair leave. All equal
pairs of a word are merged in one round, from the left and without overlap, if no better piece starts or
ends with the merged one: else a merge could bring up a better pair, and the word merges only the first.
This is the order in which the library merges, so the ids are the same.

A word of more than ``LONG`` characters merges in many places a round: every pair that comes first among those
``REACH`` places to either side. No piece is longer than a quarter of that, and a symbol that grows before
such a pair is merged starts outside those places, so it cannot come near the pair, nor near what the pair grows to
by better merges: merging it at once changes nothing. Of equal pairs that overlap every second one merges, as
above. Symbols with no pair in reach are settled and leave. Where pairs must follow one another over a whole word
(runs of spaces, whose pieces share one rank), rounds would merge a pair each; that rest takes its pairs from a queue.

Only words not met before are merged: their ids are kept in a table of bounded size.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.llm.common import pieces

# The library's space mark, and the text it decodes a broken byte to.
MARK = "\u2581"
BROKEN = "\ufffd"
NONE = np.int64(1) << np.int64(40)
# A symbol that was merged into the one before it; characters outside the vocabulary are below zero and above this.
GONE = -(1 << 40)
# Characters from which a word merges in many places a round, and the places looked at to either side of a pair (a power of two).
LONG = 512
REACH = 64
# A round that merges less than this share of the symbols is followed by the queue.
STALLED = 1 / 2048
# Words kept with their ids in each Python worker.
KEPT_WORDS = 400_000


class Model:
    """Tables of a BPE model with byte fallback, read once per worker."""

    _read: dict[str, Model] = {}

    @classmethod
    def at(cls, path: str) -> Model:
        if path not in cls._read:
            cls._read[path] = cls(path)
        return cls._read[path]

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = len(sp)
        text = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        self.ids = {text[i]: i for i in range(n) if not special[i]}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece holds a space mark after another character")
        score = np.array([sp.get_score(i) for i in range(n)])
        _, rank = np.unique(-score, return_inverse=True)
        self.rank = rank.astype(np.int64)
        self.byte = np.zeros(256, np.int64)
        for i in range(n):
            if sp.is_byte(i):
                self.byte[int(text[i][3:5], 16)] = i
        # Pairs of pieces that make a piece, as sorted keys.
        pairs = [(self.ids[p[:k]] * n + self.ids[p[k:]], i) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids]
        pairs.sort()
        self.n = n
        self.pair = np.array([k for k, _ in pairs], np.int64)
        self.made = np.array([i for _, i in pairs], np.int64)
        #: pieces that are the start or end of a better piece
        self.first_only = np.zeros(n, bool)
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                for part in (p[:k], p[k:]):
                    j = self.ids.get(part)
                    if j is not None and self.rank[i] <= self.rank[j]:
                        self.first_only[j] = True
        pieces_of = np.bincount(self.rank[np.unique(self.made)], minlength=n)
        #: pieces that come one at a time: those, and pieces that share their rank with another
        self.alone = self.first_only | (pieces_of[self.rank] > 1)
        if 4 * max(map(len, self.ids)) > REACH:
            raise ValueError("a piece is longer than a quarter of REACH")
        self.bytes_of = [b"" if sp.is_control(i) else (bytes([int(text[i][3:5], 16)]) if sp.is_byte(i) else text[i].replace(MARK, " ").encode()) for i in range(n)]
        self.is_byte = np.array([sp.is_byte(i) for i in range(n)])
        self.words: dict[bytes, tuple[bytes, int, bytes]] = {}

    def merge(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word."""
        get = self.ids.get
        flat = np.array([get(c, -ord(c) - 1) for w in words for c in w], np.int64)
        lengths = np.array([len(w) for w in words], np.int64)
        word = np.repeat(np.arange(len(words)), lengths)
        done_ids, done_words = [], []
        long = (lengths > LONG)[word]
        if long.any():
            ids, of = self._merge_long(flat[long], word[long])
            done_ids.append(ids)
            done_words.append(of)
            flat, word = flat[~long], word[~long]
        while len(flat):
            a, b = flat[:-1], flat[1:]
            ok = (word[1:] == word[:-1]) & (a >= 0) & (b >= 0)
            key = np.where(ok, a * self.n + b, -1)
            at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
            ok &= self.pair[at] == key
            made = np.where(ok, self.made[at], 0)
            # rank of the pair that starts at each symbol; none at a word's last one
            rank = np.full(len(flat), NONE)
            rank[:-1] = np.where(ok, self.rank[made], NONE)
            heads = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            best = np.minimum.reduceat(rank, heads)
            sizes = np.diff(np.concatenate((heads, [len(flat)])))
            live = np.repeat(best < NONE, sizes)
            if not live.all():
                done_ids.append(flat[~live])
                done_words.append(word[~live])
                flat, word, rank = flat[live], word[live], rank[live]
                if not len(flat):
                    break
                made = np.concatenate((made, [0]))[live]
                sizes, best = sizes[best < NONE], best[best < NONE]
                heads = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            else:
                made = np.concatenate((made, [0]))
            hit = np.flatnonzero(rank == np.repeat(best, sizes))
            # In a stretch of overlapping hits every second one merges.
            new = np.concatenate(([True], np.diff(hit) > 1))
            stretch = np.flatnonzero(new)
            place = np.arange(len(hit)) - np.repeat(stretch, np.diff(np.concatenate((stretch, [len(hit)]))))
            w = word[hit]
            lead = np.concatenate(([True], w[1:] != w[:-1]))
            # Pieces of one rank that differ, or that may bring up a better pair: the first only.
            lead_at = np.flatnonzero(lead)
            of = np.cumsum(lead) - 1
            plain = ~self.first_only[made[hit]] & (made[hit] == made[hit][lead_at][of])
            plain = np.logical_and.reduceat(plain, lead_at)[of]
            hit = hit[lead | (plain & (place % 2 == 0))]
            flat = flat.copy()
            flat[hit] = made[hit]
            keep = np.ones(len(flat), bool)
            keep[hit + 1] = False
            flat, word = flat[keep], word[keep]
        if not done_ids:
            return [np.zeros(0, np.int64) for _ in words]
        ids, word = np.concatenate(done_ids), np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        ids, word = ids[order], word[order]
        lost = np.flatnonzero(ids < 0)
        if len(lost):
            # Characters outside the vocabulary become the ids of their bytes.
            raw = [chr(-int(c) - 1).encode("utf-8", "surrogatepass") for c in ids[lost]]
            times = np.ones(len(ids), np.int64)
            times[lost] = [len(r) for r in raw]
            bare = np.repeat(ids < 0, times)
            ids, word = np.repeat(ids, times), np.repeat(word, times)
            ids[bare] = self.byte[np.frombuffer(b"".join(raw), np.uint8)]
        return np.split(ids, np.searchsorted(word, np.arange(1, len(words))))

    def _pairs(self, a: np.ndarray, b: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece, its rank) of each pair of symbols; 0 and ``NONE`` where the pair is no piece."""
        key = np.where(same & (a >= 0) & (b >= 0), a * self.n + b, -1)
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        ok = self.pair[at] == key
        made = np.where(ok, self.made[at], 0)
        return made, np.where(ok, self.rank[made], NONE)

    def _merge_long(self, flat: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, their words) of long words, merged until no pair remains."""
        place, done = np.arange(len(flat)), []
        part, made, rank = self._laid_out(flat, word, place)
        rounds = 0
        while len(flat):
            if rounds % 8 == 0:
                keep = _near(rank < NONE)
                done.append((flat[~keep], word[~keep], place[~keep]))
                if not keep.any():
                    break
                cut = np.concatenate(([0], np.cumsum(np.diff(np.flatnonzero(keep)) > 1)))
                flat, word, place, made, rank, part = (x[keep] for x in (flat, word, place, made, rank, part))
                part = np.cumsum(np.concatenate(([0], (np.diff(part) != 0) | (np.diff(cut) != 0))))
            rounds += 1
            hit = self._first_in_reach(made, rank)
            if not len(hit):
                done.append((flat, word, place))
                break
            flat[hit] = made[hit]
            keep = np.ones(len(flat), bool)
            keep[hit + 1] = False
            flat, word, place, made, rank, part = (x[keep] for x in (flat, word, place, made, rank, part))
            at = hit - np.arange(len(hit))
            at = np.unique(np.concatenate((at, np.maximum(at - 1, 0))))
            after = np.minimum(at + 1, len(flat) - 1)
            made[at], rank[at] = self._pairs(flat[at], flat[after], (part[at] == part[after]) & (after > at))
            if len(hit) < STALLED * len(flat):
                flat, word, place = self._queued(flat, word, place, made, rank, part)
                done.append((flat, word, place))
                break
        flat, word, place = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(place)
        return flat[order], word[order]

    def _laid_out(self, flat: np.ndarray, word: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        after = np.minimum(place + 1, len(flat) - 1)
        made, rank = self._pairs(flat, flat[after], (word == word[after]) & (after > place))
        return word.copy(), made, rank

    def _first_in_reach(self, made: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Places of the pairs to merge in this round."""
        n = len(rank)
        least = np.concatenate((np.full(REACH, NONE), rank, np.full(REACH, NONE)))
        width = 1
        while width < REACH:
            # least[i] is the least rank of the places i to i + 2 * width - 1
            least[:-width] = np.minimum(least[:-width], least[width:])
            width *= 2
        left, right = least[:n], least[REACH + 1 : REACH + 1 + n]
        hit = np.flatnonzero((rank < NONE) & (rank <= left) & (rank <= right))
        if not len(hit):
            return hit
        one = self.alone[made[hit]]
        # A stretch of overlapping equal pairs merges from its first one, if that is a hit.
        new = np.concatenate(([True], np.diff(hit) > 1))
        starts = np.flatnonzero(new)
        whole = (hit[starts] == 0) | (rank[hit[starts] - 1] != rank[hit[starts]])
        of = np.cumsum(new) - 1
        nth = np.arange(len(hit)) - starts[of]
        return hit[np.where(one, rank[hit] < left[hit], whole[of] & (nth % 2 == 0))]

    def _queued(self, flat, word, place, made, rank, part) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rest, pair by pair: the best rank first, of equal ones the leftmost."""
        n = len(flat)
        sym, of = flat.tolist(), part.tolist()
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        live = np.flatnonzero(rank < NONE)
        # One number a pair, rank before place. An entry holds as long as the pair there has its rank.
        queue = ((rank[live] << 40) | live).tolist()
        heapq.heapify(queue)
        table = dict(zip(self.pair.tolist(), self.made.tolist()))
        ranks, many = self.rank.tolist(), self.n

        def piece_at(i: int, j: int) -> int | None:
            if i < 0 or j >= n or of[i] != of[j] or sym[i] < 0 or sym[j] < 0:
                return None
            return table.get(sym[i] * many + sym[j])

        while queue:
            entry = heapq.heappop(queue)
            i = entry & ((1 << 40) - 1)
            j = right[i]
            piece = piece_at(i, j)
            if piece is None or ranks[piece] != entry >> 40:
                continue
            sym[i], sym[j] = piece, GONE
            right[i] = k = right[j]
            if k < n:
                left[k] = i
            for x, y in ((left[i], i), (i, k)):
                found = piece_at(x, y)
                if found is not None:
                    heapq.heappush(queue, (ranks[found] << 40) | x)
        flat = np.array(sym, np.int64)
        keep = flat != GONE
        return flat[keep], word[keep], place[keep]

    def encode_words(self, words: list[bytes]) -> list[tuple[bytes, int, bytes]]:
        """(decimal ids joined by commas, number of ids, decoded bytes) of each word."""
        known = self.words
        if len(known) > KEPT_WORDS:
            known.clear()
        fresh = [w for w in words if w not in known]
        for at in range(0, len(fresh), 50_000):
            part = fresh[at : at + 50_000]
            for w, ids in zip(part, self.merge([w.decode() for w in part])):
                ids = ids.tolist()
                known[w] = (",".join(map(str, ids)).encode(), len(ids), b"".join([self.bytes_of[i] for i in ids]))
        return [known[w] for w in words]

    def decode(self, raw: bytes) -> bytes:
        """Text of the joined bytes of all ids: the space mark put before the text goes; bytes that are no
        UTF-8 become U+FFFD, one for each."""
        raw = raw.removeprefix(b" ")
        try:
            raw.decode()
            return raw
        except UnicodeDecodeError:
            return _mend(raw)


def _near(live: np.ndarray) -> np.ndarray:
    """Places with a true one within ``REACH`` to either side."""
    seen = np.concatenate((np.zeros(REACH + 1, np.int64), np.cumsum(live), np.full(REACH, live.sum())))
    return seen[2 * REACH + 1 :] > seen[: len(live)]


def _mend(raw: bytes) -> bytes:
    out, at = [], 0
    while at < len(raw):
        try:
            out.append(raw[at:].decode())
            break
        except UnicodeDecodeError as e:
            out += [raw[at : at + e.start].decode(), BROKEN]
            at += e.start + 1
    return "".join(out).encode()


def encode_texts(model: Model, texts: pa.Array) -> tuple[list[bytes], list[int], list[bytes]]:
    """(ids joined by commas, number of ids, decoded text) of each text."""
    marked = pc.replace_substring(pc.fill_null(texts, ""), " ", MARK)
    lists = pc.split_pattern(marked, MARK)
    # The part after each mark; an empty one stands for a mark before another mark or at the end.
    coded = lists.flatten().dictionary_encode()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    code = coded.indices.to_numpy()
    parts = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)
    mark = MARK.encode()
    done = model.encode_words([mark + w for w in parts])
    ids_of, n_of, raw_of = _objects(d[0] for d in done), np.array([d[1] for d in done], np.int64), _objects(d[2] for d in done)
    empty = np.array([not w for w in parts], bool)
    runs = _runs(empty[code], offsets - offsets[0])
    ids, n, raw = ids_of[code], n_of[code], raw_of[code]
    if len(runs):
        _join_marks(model, parts, code, runs, ids, n, raw)
    out_ids, out_n, out_raw = [], [], []
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    ids_list, raw_list = ids.tolist(), raw.tolist()
    sums = np.concatenate(([0], np.cumsum(n)))
    for k, (a, b) in enumerate(zip(offsets[:-1] - offsets[0], offsets[1:] - offsets[0])):
        if not sizes[k]:
            out_ids.append(b"")
            out_n.append(0)
            out_raw.append(b"")
            continue
        here = ids_list[a:b]
        out_ids.append(b",".join(here if None not in here else [i for i in here if i is not None]))
        out_n.append(int(sums[b] - sums[a]))
        out_raw.append(model.decode(b"".join(raw_list[a:b])))
    return out_ids, out_n, out_raw


def _objects(values) -> np.ndarray:
    values = list(values)
    out = np.empty(len(values), object)
    out[:] = values
    return out


def _runs(empty: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of empty parts, with the part that follows in the same text: several marks in a row
    are one word with what follows them."""
    if not empty.any():
        return []
    doc_end = np.repeat(offsets[1:], np.diff(offsets))
    at = np.flatnonzero(empty)
    new = np.concatenate(([True], (np.diff(at) > 1) | (doc_end[at][1:] != doc_end[at][:-1])))
    heads = at[new]
    tails = np.concatenate((at[np.flatnonzero(new)[1:] - 1], at[-1:])) + 1
    return [(a, min(b + 1, doc_end[a])) for a, b in zip(heads.tolist(), tails.tolist())]


def _join_marks(model: Model, parts, code, runs, ids, n, raw) -> None:
    mark = MARK.encode()
    whole = [b"".join(mark + parts[c] for c in code[a:b]) for a, b in runs]
    distinct = list(dict.fromkeys(whole))
    done = dict(zip(distinct, model.encode_words(distinct)))
    for (a, b), w in zip(runs, whole):
        ids[a], n[a], raw[a] = done[w]
        ids[a + 1 : b], n[a + 1 : b], raw[a + 1 : b] = None, 0, b""


def encode(docs: DataFrame, model: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256, ids_text, decoded)`` of each text.

    Null and empty texts have no ids. Nothing is shuffled; every row stands for itself, so repeated
    rows, null ids and further columns do not matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Model.at(model)
        for batch in pieces(batches, "text"):
            ids, n, decoded = encode_texts(table, batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(n, pa.int64()),
                    pa.array([hashlib.sha256(i).hexdigest() for i in ids]), pa.array([hashlib.sha256(d).hexdigest() for d in decoded]),
                    pa.array(ids, pa.binary()).cast(pa.string()), pa.array(decoded, pa.binary()).cast(pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids_text", "decoded"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids_text string, decoded string")
