"""Word BPE against the library on whole tables, random texts and odd rows."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodeweave.llm import word_bpe
from lodeweave.llm.queries import WORD_PIECES, op12_word_bpe


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD_PIECES)


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    told, back = " ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), told, back


def check(spark, library, texts):
    df = spark.createDataFrame([(k, t, 1, 2, 3) for k, t in enumerate(texts)], "doc_id long, text string, block int, word int, ids int")
    got = {r[0]: tuple(r)[1:] for r in word_bpe.encode(df, WORD_PIECES).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        assert got[k] == expected(library, t), repr(t)[:200]


def test_documents(spark, sf, library):
    want = {r["doc_id"]: expected(library, r["text"])[:3] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r[0]: tuple(r)[1:] for r in op12_word_bpe(spark, sf).collect()} == want


def test_random_texts(spark, library):
    r = random.Random(1)
    plain = [chr(c) for c in range(1, 0x300)]
    odd = [*"abcABC'sStTreveLLmd \n\t\x85\xa0\x1c\x00é日İıſẞΣσςK①½²́̈　‏ǅ٣ªº·_-!?’", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "'ll", "n't", "가", "\U0001f600", "\U0001e900"]
    any_ = [chr(c) for c in range(0x300, 0x30000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(r.choice(s) for _ in range(r.randrange(40))) for s in (plain, odd, any_, "ab 's'd1!") for _ in range(600)]
    check(spark, library, texts)


def test_odd_rows(spark, library, monkeypatch):
    monkeypatch.setattr(word_bpe, "BLOCK_WORDS", 50)
    texts = [None, "", " \t\n", "one", "one", "a b c " * 30, "<|endoftext|>", "x" * 200_000, " ".join(f"w{k}" for k in range(20_000)), "é日本 \u0000 \U0001f600 " * 25, None, ""]
    monkeypatch.setattr(word_bpe, "SLICE_WORDS", 20)
    check(spark, library, texts)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert word_bpe.encode(none, WORD_PIECES).count() == 0
    same = spark.createDataFrame([(None, "a b"), (None, "a b"), (7, "a"), (7, "a")], "doc_id long, text string")
    assert word_bpe.encode(same, WORD_PIECES).count() == 4


def test_words_are_dealt_once(spark, sf, monkeypatch):
    """The join of the lists with the distinct words shuffles nothing but the distinct words."""
    plans = []
    real = word_bpe.table

    def spy(df, name):
        if name == "lists":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, name)

    monkeypatch.setattr(word_bpe, "table", spy)
    answers = word_bpe.encode(spark.read.parquet(f"{sf}/documents.parquet"), WORD_PIECES)
    (plan,) = plans
    last = answers._jdf.queryExecution().executedPlan().toString()
    texts = last[last.index("FlatMapCoGroups") : last.index("FileScan parquet")]
    assert "Exchange" not in texts and "codes" in texts  # the positions stay in their bucket
    assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in plan and "SortMergeJoin [part" in plan


def test_decode_is_the_inverse_of_the_table(spark, library):
    ids = [[], [1, 2, 3], [49406, 49407], None, [320]]
    df = spark.createDataFrame(list(enumerate(ids)), "k int, ids array<int>")
    got = dict(word_bpe.decode(df, WORD_PIECES, ["k"]).orderBy(F.col("k")).collect())
    assert got == {k: library.decode(i or [], skip_special_tokens=False) for k, i in enumerate(ids)}
