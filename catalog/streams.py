from __future__ import annotations

from pyspark.sql import functions as F

from catalog import base
from catalog.base import with_ctes
from lodeweave.session import new_path
from lodeweave.sources import readers
from lodeweave.streaming import events as ev
from lodeweave.streaming import ingest, run

QUERIES: dict = {}
SQL: dict = {}


def _events(spark, d):
    return readers.stream_events(spark, readers.stream_path(d, "events"))


def _plain(df):
    """Timestamps without zone, as the given tables have them."""
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes])


def stream_events(spark, d):
    out, _ = run.run_to_table(_events(spark, d), "events")
    return _plain(out)


def stream_ingest(spark, d):
    docs = readers.stream_documents(spark, readers.stream_path(d, "documents"))
    post = ingest.StreamIndex(spark).ingest(docs).postings()
    return post.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


def stream_ingest_graph(spark, d):
    docs = readers.stream_documents(spark, readers.stream_path(d, "documents"))
    return ingest.StreamIndex(spark).ingest(docs).edges()


def event_windows(spark, d):
    out, _ = run.run_to_table(ev.windows(_events(spark, d), "1 hour"), "windows")
    return _plain(out).withColumn("total", F.round("total", 4))


def event_windows_sliding(spark, d):
    out, _ = run.run_to_table(ev.windows(_events(spark, d), "2 hours", "1 hour"), "windows")
    return _plain(out).withColumn("total", F.round("total", 4))


def event_sessions(spark, d):
    out, _ = run.run_to_table(ev.sessions(_events(spark, d), "30 minutes"), "sessions")
    return _plain(out)


def stream_join(spark, d):
    views = _events(spark, d).where("event_type = 'view'")
    buys = _events(spark, d).where("event_type = 'purchase'")
    out, _ = run.run_to_table(ev.interval_join(views, buys, 3600), "joined")
    return _plain(out)


def user_state(spark, d):
    root = new_path(spark, "profiles")
    run.run_batches(
        ev.profiles(_events(spark, d)),
        lambda df, n: df.write.mode("overwrite").parquet(f"{root}/batch={n}"),
        "profiles",
        "update",
    )
    rows = spark.read.schema("user_id bigint, n bigint, total double, last timestamp, batch bigint").parquet(root)
    last = rows.groupBy("user_id").agg(F.max_by(F.struct("n", "total", "last"), "batch").alias("p"))
    return _plain(last.select("user_id", "p.n", F.round("p.total", 4).alias("total"), "p.last"))


def stream_graph(spark, d):
    out, _ = run.run_to_table(ev.activity_edges(_events(spark, d), "1 day"), "activity")
    return _plain(out)


def stream_retrieve(spark, d):
    asked = (
        spark.readStream.schema(readers.BENCHMARK)
        .parquet(readers.stream_path(d, "benchmark"))
        .select(F.col("item_id").alias("q_id"), "text")
    )
    i = base.index(spark, d)
    return base.hits_out(ingest.answer_stream(asked, i["postings"], i["stats"], i["rarity"], 5))


for _f in (
    stream_events, stream_ingest, stream_ingest_graph, event_windows, event_windows_sliding, event_sessions, stream_join,
    user_state, stream_graph, stream_retrieve,
):
    QUERIES[_f.__name__] = _f

_MARK = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"
SQL["stream_events"] = "SELECT * FROM events"
SQL["stream_ingest"] = with_ctes("SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf FROM posts GROUP BY term")
SQL["stream_ingest_graph"] = with_ctes("SELECT src, dst, weight FROM edges")
SQL["event_windows"] = f"""
SELECT date_trunc('hour', ts) AS start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS "end", event_type, count(*) AS n, round(sum(value), 4) AS total
FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= {_MARK} GROUP BY ALL"""
SQL["event_windows_sliding"] = f"""
SELECT start, start + INTERVAL 2 HOUR AS "end", event_type, count(*) AS n, round(sum(value), 4) AS total
FROM (SELECT *, date_trunc('hour', ts) - INTERVAL 1 HOUR * k AS start FROM events, (SELECT unnest([0, 1]) AS k))
WHERE start + INTERVAL 2 HOUR <= {_MARK} GROUP BY ALL"""
SQL["event_sessions"] = f"""
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (
    SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events))
GROUP BY user_id, s HAVING max(ts) + INTERVAL 30 MINUTE <= {_MARK}"""
SQL["stream_join"] = """
SELECT v.user_id, v.event_id AS view_id, p.event_id AS purchase_id, v.ts AS view_ts, p.ts AS purchase_ts
FROM events v JOIN events p ON p.user_id = v.user_id AND p.ts BETWEEN v.ts AND v.ts + INTERVAL 1 HOUR
WHERE v.event_type = 'view' AND p.event_type = 'purchase'"""
SQL["user_state"] = "SELECT user_id, count(*) AS n, round(sum(value), 4) AS total, max(ts) AS last FROM events GROUP BY user_id"
SQL["stream_graph"] = f"""
SELECT date_trunc('day', ts) AS start, 'user:' || user_id AS src, 'type:' || event_type AS dst, count(*) AS weight
FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= {_MARK} GROUP BY ALL"""
SQL["stream_retrieve"] = with_ctes("SELECT q_id, chunk_id, score, rank, via FROM bm25_hits WHERE rank <= 5")
