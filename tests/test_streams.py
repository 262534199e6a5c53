import datetime as dt

from pyspark.sql import functions as F

from lodeweave.operators import corpus, graph_build, retrieve
from lodeweave.session import new_path
from lodeweave.sources import readers
from lodeweave.streaming import events as ev
from lodeweave.streaming import ingest, run

T0 = dt.datetime(2024, 1, 1)


def write_events(spark, path, rows):
    data = [(i, T0 + dt.timedelta(minutes=m), u, t, 1.0, "{}") for i, m, u, t in rows]
    spark.createDataFrame(data, readers.EVENTS).coalesce(1).write.mode("append").parquet(path)


def test_ingest_in_parts_equals_batch(spark, sf):
    docs = readers.read_documents(spark, sf).select("doc_id", "text", "lang", "source", "n_chars")
    src = new_path(spark, "docs")
    for part in ("doc_id < 100", "doc_id >= 100"):
        docs.where(part).coalesce(1).write.mode("append").parquet(src)
    index = ingest.StreamIndex(spark).ingest(readers.stream_documents(spark, src, max_files=1))
    cols = ["term", "chunk_id", "tf"]
    got = index.postings().select(cols)
    want = retrieve.postings(corpus.chunk(corpus.dedup(docs))).select(cols)
    assert got.groupBy("term").agg(F.sum("tf")).exceptAll(want.groupBy("term").agg(F.sum("tf"))).isEmpty()
    want_mentions = graph_build.term_entities(corpus.chunk(corpus.dedup(docs)), corpus.dedup(docs))
    assert sorted(index.mentions().select("entity", "chunk_id", "n").collect()) == sorted(want_mentions.collect())
    edges = sorted(index.edges().collect())
    assert edges == sorted(graph_build.cooccur(want_mentions).collect()) and edges
    before = index.postings().count()
    assert before == want.count()
    last = index.postings().agg(F.max("batch")).first()[0]
    stored = index.spark.read.parquet(src)
    index.add(stored.join(index.chunks().where(F.col("batch") == last).select("doc_id").distinct(), "doc_id", "left_semi"), last)
    assert index.postings().count() == before
    assert sorted(index.edges().collect()) == edges


def test_pairs_are_stored_by_ids_that_stay(spark):
    index = ingest.StreamIndex(spark, df_lo=2)
    parts = [[(1, "zebra apple"), (2, "zebra apple mango")], [(3, "mango zebra"), (4, "aaaaa apple"), (5, "aaaaa")]]
    for batch, rows in enumerate(parts):
        index.add(spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], readers.DOCUMENTS), batch)
    assert {t for _, t in index._stored("pairs").dtypes[:2]} == {"int"}
    # Names of the second batch come before those of the first, their ids after.
    ids = {r["entity"]: r["id"] for r in index.entities().collect()}
    assert ids == {"apple": 0, "zebra": 1, "aaaaa": 2, "mango": 3}
    want = [("aaaaa", "apple", 1), ("apple", "mango", 1), ("apple", "zebra", 2), ("mango", "zebra", 2)]
    assert sorted(tuple(r) for r in index.edges(1).collect()) == want


def test_late_and_repeated_events(spark):
    path = new_path(spark, "events")
    write_events(spark, path, [(1, 0, 1, "view"), (1, 0, 1, "view"), (2, 30, 1, "view"), (3, 600, 1, "view")])
    stream = readers.stream_events(spark, path, max_files=1)
    out, query = run.run_to_table(ev.windows(stream, "1 hour"), "windows")
    assert [(r["n"], r["event_type"]) for r in out.collect()] == [(2, "view")]
    assert run.late_rows(query) == 0


def test_rows_behind_the_watermark_are_dropped_and_counted(spark):
    path = new_path(spark, "events")
    write_events(spark, path, [(1, 0, 1, "view"), (2, 600, 1, "view")])
    write_events(spark, path, [(3, 610, 1, "view")])
    write_events(spark, path, [(4, 5, 1, "view"), (5, 1200, 1, "view")])
    stream = readers.stream_events(spark, path, max_files=1)
    out, query = run.run_to_table(ev.windows(stream, "1 hour"), "windows")
    assert sum(r["n"] for r in out.collect() if r["n"]) >= 1
    assert run.late_rows(query) == 1


def test_interval_join_bounds(spark):
    path = new_path(spark, "events")
    write_events(spark, path, [(1, 0, 1, "view"), (2, 60, 1, "purchase"), (3, 61, 1, "purchase"), (4, 10, 2, "purchase")])
    s = readers.stream_events(spark, path)
    out, _ = run.run_to_table(ev.interval_join(s.where("event_type = 'view'"), readers.stream_events(spark, path).where("event_type = 'purchase'"), 3600), "joined")
    assert [(r["view_id"], r["purchase_id"]) for r in out.collect()] == [(1, 2)]


def test_queries_cover_their_sql():
    import catalog

    assert set(catalog.SQL) == set(catalog.QUERIES)
