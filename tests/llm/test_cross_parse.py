import random
import zlib

from lodeweave.llm import cross_parse as cp


def greedy(text, train):
    """Number of phrases by plain search."""
    n = at = 0
    while at < len(text):
        k = 1
        while at + k < len(text) and text[at : at + k + 1] in train:
            k += 1
        at, n = at + k, n + 1
    return n


def test_phrases_against_plain_search(monkeypatch):
    monkeypatch.setattr(cp, "BLOCK", 64)
    rng = random.Random(2)
    sample = {"x": ["".join(rng.choice("abc ") for _ in range(300))], "y": ["".join(rng.choice("abd ") for _ in range(300))]}
    parser = cp.Parser(sample)
    texts = ["".join(rng.choice("abcd e") for _ in range(rng.randint(1, 200))) for _ in range(50)]
    train = {k: "".join(map(chr, [*parser.squeeze(v[0])[0].tolist(), 0, 0])) for k, v in sample.items()}
    langs, scores = parser.predict(texts)
    for t, lang, score in zip(texts, langs, scores):
        c, ok = parser.squeeze(t)
        if not ok:
            assert lang == "und"
            continue
        s = "".join(map(chr, c.tolist()))
        cost = {k: sum(greedy(s[a : a + 64], train[k]) for a in range(0, len(s), 64)) * parser.bits[j] for j, k in enumerate("xy")}
        assert lang == min(sorted(cost), key=cost.get) and 0.5 <= score <= 1


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    got = cp.identify(docs).collect()
    assert len(got) == len(truth)
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    right = sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held)
    print("held-out accuracy", right)
    assert right > 0.95


def test_nulls_and_empty(spark):
    schema = "doc_id long, text string, lang string, score int"
    rows = [(1, "the and of the", "en", 1), (2, None, "en", 1), (3, "12 !!", None, 1), (None, "le la de la", "fr", 1), (5, "le la les de", "fr", 1), (5, "le la les de", "fr", 1), (6, "", "de", 1)]
    got = cp.identify(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 7
    assert {r["lang_pred"] for r in got if r["doc_id"] in (2, 3, 6)} == {"und"}
    assert cp.identify(spark.createDataFrame([], schema)).count() == 0
    unlabelled = spark.createDataFrame([(1, "some text", None, 1)], schema)
    assert cp.identify(unlabelled).collect()[0]["lang_pred"] == "und"
