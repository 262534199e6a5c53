import hashlib
import random
import time

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from lodeweave.llm import pieces_bpe
from lodeweave.llm.pieces_bpe import Model, encode, encode_texts

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def odd_texts():
    rng = random.Random(5)
    out = ["", " ", "  ", "   a", "a ", " a  b   c    ", "\u2581x \u2581", "a\n\n b\t\r\n c", "日本語 テスト😀 \u0000", "x" * 3000, "ab" * 2000, "aaaa " * 40, " " * 77, "e\u0301 ｆｕ", "\u00a0 \u2028x", "\ufeffa"]
    alphabet = "abcdefghijklmnopqrstuvwxyz   \n\tABCéüñß0123456789.,!?()[]{}<>=+-_\u2581日本語😀"
    out += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 300))) for _ in range(400)]
    out += ["".join(rng.choice("aehinst ") for _ in range(200)) for _ in range(200)]
    return out


def test_same_ids_as_the_library(sp):
    texts = odd_texts()
    ids, n, decoded = encode_texts(Model.at(PATH), pa.array([*texts, None]))
    for t, i, k, d in zip([*texts, ""], ids, n, decoded):
        want = sp.encode(t)
        assert i.decode() == ",".join(map(str, want)), repr(t)
        assert k == len(want) and d.decode() == sp.decode(want), repr(t)


def long_words(rng, model):
    parts = [p.strip("\u2581") for p in model.ids if len(p) > 2]
    for alphabet in ("ab", "aehinst", "abcdefghijklmnopqrstuvwxyz", "ABCDabcd0123+/=", "日本語テストa", "\u00e9\U0001f600z"):
        for size in (9, 40, 700, 3000):
            yield "".join(rng.choice(alphabet) for _ in range(size))
    for _ in range(60):
        yield "".join(rng.choice(parts) for _ in range(300))
        # One stretch over and over: pairs that must follow one another.
        yield "".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) * 200
        yield "".join(rng.choice([" " * rng.randint(1, 40), rng.choice(parts), "=" * rng.randint(1, 50)]) for _ in range(100))


@pytest.mark.parametrize("least", [8, 512])
def test_long_words_merge_in_many_places_as_the_library_does(sp, monkeypatch, least):
    monkeypatch.setattr(pieces_bpe, "LONG", least)
    model = Model(PATH)
    texts = list(long_words(random.Random(11), model))
    ids, n, decoded = encode_texts(model, pa.array(texts))
    for t, i, k, d in zip(texts, ids, n, decoded):
        want = sp.encode(t)
        assert i.decode() == ",".join(map(str, want)), repr(t[:80])
        assert k == len(want) and d.decode() == sp.decode(want), repr(t[:80])


def test_a_word_of_a_megabyte_takes_seconds(sp):
    rng = random.Random(3)
    for t in ("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000)), " " * 300_000, "a" * 300_000):
        start = time.time()
        ids, _, _ = encode_texts(Model(PATH), pa.array([t]))
        assert time.time() - start < 60
        assert ids[0].decode() == ",".join(map(str, sp.encode(t)))


def test_documents(spark, sf, sp):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = encode(docs, PATH).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = sp.encode(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def test_nulls_repeats_and_empty_table(spark):
    rows = [(None, None, 1), (1, "", 2), (1, "", 2), (2, "a b", 3), (2, "a b", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted(((r["doc_id"] or -1), r["n_tokens"], r["decoded"]) for r in encode(df, PATH).collect())
    assert got == [(-1, 0, ""), (1, 0, ""), (1, 0, ""), (2, 2, "a b"), (2, 2, "a b")]
    assert encode(df.limit(0), PATH).count() == 0
