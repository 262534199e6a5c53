import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from lodeweave.operators import corpus, graph_build
from lodeweave.sources import readers


def docs(spark, texts):
    return spark.createDataFrame(
        [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long"
    )


def test_chunk_edges(spark):
    sizes = [0, 1, 63, 64, 65, 112, 113]
    d = docs(spark, [" ".join(f"w{i}" for i in range(n)) for n in sizes])
    got = {r["doc_id"]: r["n"] for r in corpus.chunk(d).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 2, 5: 2, 6: 3}
    seen = corpus.chunk(d).where("doc_id = 6").select(F.explode(F.split("text", " ")).alias("w")).distinct().count()
    assert seen == 113


def test_long_piece_is_split(spark):
    d = docs(spark, ["x" * 1000])
    assert corpus.chunk(d).first()["text"].replace(" ", "") == "x" * 1000


def test_tokens_are_unicode(spark):
    assert corpus.tokens(docs(spark, ["Éa b1c ÑU"])).first()["tokens"] == ["éa", "b", "c", "ñu"]


def test_page_text(spark):
    html = '<html><head><title>A &amp; B</title></head><script>var t="</p>";</script><!-- x --><p>Hi&nbsp;<b>you</b></p></html>'
    row = corpus.page_text(spark.createDataFrame([(1, "http://a/b", html)], readers.PAGES)).first()
    assert (row["title"], row["text"]) == ("A & B", "Hi you")


def test_dedup_keeps_the_least_id(spark):
    assert {r["doc_id"] for r in corpus.dedup(docs(spark, ["a", "b", "a", "a"])).collect()} == {0, 1}


def test_near_edges_meet_the_leader_once(spark):
    base = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(10)]
    texts = [" ".join(base)] + [" ".join(base[:k] + ["odd" + chr(97 + k)] + base[k + 1 :]) for k in range(0, 60, 6)]
    texts += [" ".join(base[:30] + [f"z{chr(97 + i)}{chr(97 + j)}" for i in range(3) for j in range(10)]), "two words", "Two  words!"]
    d = docs(spark, texts)
    sets = {r[0]: set(r[1]) for r in d.select("doc_id", corpus.shingle_hashes(F.col("text"), 3)).collect()}
    sig = {r[0]: r[1] for r in d.select("doc_id", corpus.minhash(corpus.shingle_hashes(F.col("text"), 3), 8)).collect()}
    buckets = {}
    for i, s in sig.items():
        for b in range(4):
            buckets.setdefault((b, tuple(s[2 * b : 2 * b + 2])), []).append(i)
    want = {(m, min(v)) for v in buckets.values() for m in v if m > min(v) and len(sets[m] & sets[min(v)]) / len(sets[m] | sets[min(v)]) >= 0.8}
    got = {(r["src"], r["dst"]) for r in corpus.near_edges(d, 8, 4, 0.8).collect()}
    assert got == want and (13, 12) in want


def test_recall_on_planted_copies(spark):
    rng = random.Random(6)
    fresh = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    texts, pairs = [], []
    for share in (0.7, 0.8, 0.9):
        for _ in range(60):
            base = [fresh() for _ in range(120)]
            changed = list(base)
            # n changed words in a row leave (118 - n - 2) of 118 + n + 2 shingles
            n = round(118 * (1 - share) / (1 + share)) - 2
            changed[20 : 20 + n] = [fresh() for _ in range(n)]
            pairs.append((share, len(texts)))
            texts += [" ".join(base), " ".join(changed)]
    got = {(r["src"], r["dst"]) for r in corpus.near_edges(docs(spark, texts), min_jaccard=0.65).collect()}
    found = {share: sum((k + 1, k) in got for s, k in pairs if s == share) / 60 for share in (0.7, 0.8, 0.9)}
    assert found[0.7] >= 0.85 and found[0.8] >= 0.95 and found[0.9] == 1


def sets_of(rng, n, common):
    """Sets of three kinds: fresh ones, ones on a common stock, and near copies of earlier ones."""
    out = []
    for i in range(n):
        kind = rng.random()
        if out and kind < 0.4:
            s = set(rng.choice(out)) ^ {rng.choice(common) for _ in range(rng.randint(0, 12))}
        elif kind < 0.8:
            s = set(rng.sample(common, 40)) | {1000 * i + k for k in range(10_000, 10_000 + rng.randint(0, 15))}
        else:
            s = {1000 * i + k for k in range(10_000, 10_000 + rng.randint(1, 40))}
        out.append(s or {1})
    return out


@pytest.mark.parametrize("least", [0.5, 0.7, 0.9])
def test_similar_pairs_equal_brute_force(spark, least):
    rng = random.Random(8)
    sets = sets_of(rng, 160, list(range(50)))
    part = [rng.choice([i, i % 5]) for i in range(len(sets))]
    df = spark.createDataFrame([(i, part[i], sorted(s)) for i, s in enumerate(sets)], "doc_id long, part long, s array<bigint>")
    want = {(a, b) for a in range(len(sets)) for b in range(a) if part[a] != part[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least}
    for rows_per_task in (4096, 20):
        got = [(r["doc_id"], r["head"]) for r in corpus.similar_pairs(df, least, rows_per_task).collect()]
        assert len(got) == len(set(got)) and set(got) == want and want
    assert corpus.similar_pairs(df.limit(0), least).count() == 0


@pytest.mark.parametrize("share", [0.7, 0.84, 0.9])
def test_copies_behind_a_template_are_found(spark, share):
    """150 documents of one template, none near another, lead the buckets of the pairs behind them."""
    rng = random.Random(9)
    fresh = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    stock = [fresh() for _ in range(100)]
    texts = [" ".join(stock + [fresh() for _ in range(25)]) for _ in range(150)]
    pairs = []
    for _ in range(12):
        base = stock + [fresh() for _ in range(25)]
        changed = list(base)
        n = int(123 * (1 - share) / (1 + share)) - 2
        changed[100 : 100 + n] = [fresh() for _ in range(n)]
        pairs.append(len(texts))
        texts += [" ".join(base), " ".join(changed)]
    d = docs(spark, texts)
    sets = {r[0]: set(r[1]) for r in d.select("doc_id", corpus.shingle_hashes(F.col("text"), 3)).collect()}
    assert all(share <= len(sets[k] & sets[k + 1]) / len(sets[k] | sets[k + 1]) for k in pairs)
    assert max(len(sets[k] & sets[i]) / len(sets[k] | sets[i]) for k in pairs for i in range(150)) < 0.7
    cluster = {r["doc_id"]: r["cluster"] for r in corpus.near_clusters(d).collect()}
    assert all(cluster[k] == cluster[k + 1] == k for k in pairs)
    assert all(cluster[i] == i for i in range(150))


def test_frequent_terms_stay_entities(spark):
    d = docs(spark, [f"common thing number{chr(97 + k)}" for k in range(26)])
    band = {r["entity"]: r["df"] for r in graph_build.entity_band(d).collect()}
    assert band == {"common": 26, "thing": 26}


def test_resolve_equals_edit_distance_closure(spark):
    names = ["alpha", "alphb", "alphbc", "beta", "betas", "bet", "gamma", "élan", "elan", "elann", "zz"]
    df = spark.createDataFrame([(n,) for n in names], "entity string")

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        if abs(len(a) - len(b)) != 1:
            return False
        s, t = sorted((a, b), key=len)
        return any(t[:i] + t[i + 1 :] == s for i in range(len(t)))

    root = {n: n for n in names}
    for _ in names:
        for a, b in itertools.permutations(names, 2):
            if near(a, b):
                root[a] = root[b] = min(root[a], root[b])
    assert {r["entity"]: r["canonical"] for r in graph_build.resolve(df).collect()} == root


def test_chunk_udtf_equals_chunk(spark, sf):
    import catalog

    a = catalog.QUERIES["chunk_udtf"](spark, sf)
    b = catalog.QUERIES["chunk_tokens"](spark, sf).select(a.columns)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_cooccur_counts_chunks(spark):
    m = spark.createDataFrame([("b", "1", 1), ("a", "1", 2), ("a", "2", 1), ("b", "2", 1), ("c", "2", 1)], "entity string, chunk_id string, n long")
    assert [tuple(r) for r in graph_build.cooccur(m, 2).collect()] == [("a", "b", 2)]


def test_long_matches_are_found_whole(spark):
    """A URL of 300 characters over pieces and chunks, matches at the edges of chunks, and texts without any."""
    url = "http://host.example/" + "a1-" * 94
    filler = [f"w{i}" for i in range(200)]
    texts = {
        1: " ".join([*filler[:62], url, *filler[62:]]),
        2: " ".join([*filler[:47], "x@y.org", "1234567", *filler[:80]]),
        3: None,
        4: "",
        5: "((" + "z" * 70 + ":" + url + " 7654321",
        6: "9" * 200,
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {(r["entity"], r["chunk_id"]): r["n"] for r in graph_build.typed_mentions(docs).collect()}
    assert {c for e, c in got if e == "url:" + url} == {"1:0", "1:1", "5:0"}
    assert {c for e, c in got if e == "email:x@y.org"} == {"2:0"} and {c for e, c in got if e == "number:1234567"} == {"2:0", "2:1"}
    assert got["number:" + "9" * 200, "6:0"] == 1 and got["number:7654321", "5:0"] == 1
    assert set(got.values()) == {1}
    # the chunks named are chunks, and hold the start of their match
    pieces = {r["chunk_id"]: r["text"] for r in corpus.chunk(docs.where("text <> ''")).collect()}
    assert all(e.split(":", 1)[1][:20] in pieces[c].replace(" ", "") for e, c in got)


def test_entity_resolve_needs_no_table_of_mentions(spark, sf, monkeypatch):
    import catalog
    from catalog import base

    monkeypatch.setattr(base, "_INDEXES", {})
    got = {r["entity"] for r in catalog.QUERIES["entity_resolve"](spark, sf).collect()}
    index = base.index(spark, sf)
    assert not {"mentions", "postings"} & set(index._built)
    assert got == {r["entity"] for r in index["mentions"].select("entity").distinct().collect()}


def test_gazetteer_mentions_of_a_held_dictionary_are_not_shuffled(spark):
    chunks = spark.createDataFrame([("1:0", "Red hot red hot tin"), ("2:0", "hot tin"), ("3:0", None)], "chunk_id string, text string")
    names = spark.createDataFrame([("red-hot",), ("tin",), ("blue",)], "name string")
    held, met = graph_build.gazetteer_mentions(chunks, names), graph_build.gazetteer_mentions(chunks, names, 0)
    want = [("red hot", "1:0", 2), ("tin", "1:0", 1), ("tin", "2:0", 1)]
    assert sorted(tuple(r) for r in held.collect()) == sorted(tuple(r) for r in met.collect()) == want
    assert "Exchange hashpartitioning" not in held._jdf.queryExecution().executedPlan().toString()
