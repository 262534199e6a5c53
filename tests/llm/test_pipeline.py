import hashlib
from collections import Counter

import duckdb
import pandas as pd
import pytest
import sentencepiece

import corpus_pipeline
from lodeweave.llm import surrogates
from lodeweave.llm.queries import _OP7, PIECES, QUALITY
from tests.llm.test_similar import brute_least

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = " ".join(f"word{k}" for k in range(60))
ODD = [
    (None, None, None, None, None), (900, "", "en", None, 0), (901, None, "en", "a", None), (902, "x y " * 40, "en", "a", 1),
    (903, f"{PROSE} Mr John Doe wrote", None, None, 5), (903, f"{PROSE} Mr John Doe wrote", None, None, 5), (904, f"{PROSE} Mr John Doe wrote", "en", "b", 5),
    (905, " ".join(f"long{k}" for k in range(40_000)), "en", "b", 7),
]


def brute(rows):
    """The five stages in plain Python and DuckDB."""
    con = duckdb.connect()

    def sql(text, rows):
        frame = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]).astype({"doc_id": "Int64", "n_chars": "Int64"})
        con.register("documents", frame)
        return con.sql(text).fetchall()

    # The SQL joins on the id, so places stand for ids.
    kept = {r[0] for r in sql(f"WITH q_in AS (SELECT * FROM documents), {QUALITY} SELECT doc_id FROM q_out WHERE kept", [(k, *r[1:]) for k, r in enumerate(rows)])}
    rows = [r for k, r in enumerate(rows) if k in kept]
    least = brute_least([r[:2] for r in rows])
    rows = list({r[0]: r for r, k in zip(rows, least) if r[0] == k}.values())
    rows = [(r[0], surrogates.rewrite(r[1], surrogates.KEY, {}, {})[0], *r[2:]) for r in rows]
    times = {i: taken // size for i, size, _, _, taken in sql(_OP7, rows)}
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    out = Counter()
    for i, text, *_ in rows:
        ids = sp.encode(text)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[i, len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids))] += times[i]
    return +out


def write(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_against_brute_force(spark, sf, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    rows = [r for r in rows if r[0] < 900] + ODD
    got = corpus_pipeline.run(spark, write(spark, tmp_path, rows)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    # Rows with one id are rows of one text here, so the ids can stand for them.
    assert Counter(map(tuple, got)) == brute(rows)
    assert len(got) > 100


def test_stages_keep_the_columns(spark, sf):
    docs = spark.createDataFrame(ODD, SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == [f.split()[0] for f in SCHEMA.split(", ")]


@pytest.mark.parametrize("rows", [[], ODD[:2]])
def test_nothing_left(spark, tmp_path, rows):
    assert corpus_pipeline.run(spark, write(spark, tmp_path, rows)).count() == 0
