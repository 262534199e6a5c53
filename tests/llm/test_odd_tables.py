"""Every operator on tables with nulls, repeated rows and columns that carry the names of its own."""

import pytest

from lodeweave.llm import cross_parse, html_main, mixing, neighbours, pieces_bpe, quality, repeats, shards, similar, simhash, surrogates
from lodeweave.llm.queries import PIECES

TEXTS = [None, "", " \t\n", "one", "one", "a b c " * 30, "a b c " * 30, " ".join(f"w{k}" for k in range(20_000)), "é日本 \u0000 \U0001f600 " * 25]
NAMES = "rid did at n pos k1 k2 bucket kind block fp r h b pid size shard slot law list chunk q v key least own target taken rank score kept value metric held_out lang_pred fingerprint kl ks turn form".split()

OPERATORS = {
    "repeats": repeats.remove_repeats,
    "pieces": lambda d: pieces_bpe.encode(d, PIECES),
    "surrogates": surrogates.hide,
    "surrogates_rows": surrogates.hide_rows,
    "language": cross_parse.identify,
    "quality": quality.score,
    "mixing": mixing.mix,
    "simhash": simhash.near_copies,
    "shards": shards.shard,
}


def table(spark, rows):
    cols = ", ".join(["doc_id long", "text string", "lang string", "source string", *[f"`{n}` int" for n in NAMES]])
    return spark.createDataFrame([(*r, *[7] * len(NAMES)) for r in rows], cols)


@pytest.mark.parametrize("name", OPERATORS)
def test_documents(spark, name):
    rows = [(k, t, "en" if k % 2 else None, None if k % 3 else "s") for k, t in enumerate(TEXTS)]
    rows += [(None, t, None, None) for t in TEXTS] + rows[3:5]
    got = OPERATORS[name](table(spark, rows)).select("doc_id").collect()
    assert sorted(repr(r[0]) for r in got) == sorted(repr(r[0]) for r in rows)
    assert OPERATORS[name](table(spark, [])).count() == 0


@pytest.mark.parametrize("stage", [quality.keep_good, similar.keep_one, surrogates.hide_rows, mixing.take])
def test_stages_keep_clashing_columns(spark, stage):
    df = table(spark, [(k, t, "en", "s") for k, t in enumerate(TEXTS)])
    out = stage(df)
    assert out.columns == df.columns
    out.collect()


def test_capped_sources_are_not_ranked(spark):
    """A source at twice its size has nothing left to draw, whatever the ranks."""
    rows = [(k, f"w{k} " * (1 + k % 5), "en", "a") for k in range(200)] + [(1000 + k, "w " * 400, "en", "b") for k in range(50)]
    got = mixing.mix(table(spark, rows)).collect()
    assert {r["taken"] // r["size"] for r in got if r["doc_id"] < 1000} == {2}


def test_pages_and_vectors(spark):
    pages = spark.createDataFrame([(None, None, None, 1, 2), (1, "u", "", 1, 2), (1, "u", "", 1, 2), (2, "v", "<p>a &amp; b" * 3000, 1, 2)], "page_id long, url string, html string, text int, n_chars int")
    assert html_main.extract(pages).count() == 4
    assert html_main.extract(pages.limit(0)).count() == 0
    rows = [(0, [1.0, 0.0], 1, 1), (0, [1.0, 0.0], 1, 1), (1, [1.0, 0.0], 1, 1), (2, [0.0, None], 1, 1), (3, None, 1, 1), (None, [1.0, 1.0], 1, 1), (4, [0.0, 0.0], 1, 1), (5, [1.0, 1.0], 1, 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, list int, q int")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in neighbours.search(vectors).orderBy("rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 5)]
