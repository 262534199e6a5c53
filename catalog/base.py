"""Shared inputs of the registered queries, as DataFrames and as SQL.

``with_ctes(body)`` puts the named expressions a statement uses in front of it, so
each check reads as one query over the given tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.operators import corpus, retrieve
from lodeweave.plans.build import Index
from lodeweave.sources import readers

CTES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    CTES[name] = sql.strip()


def _used(text: str) -> list[str]:
    used: list[str] = []

    def visit(part: str) -> None:
        for name in CTES:
            if name not in used and re.search(rf"(FROM|JOIN|,)\s+{name}\b", part):
                visit(CTES[name])
                if name not in used:
                    used.append(name)

    visit(text)
    return used


def with_ctes(body: str, own: str = "") -> str:
    """``body`` with the shared expressions it uses and then its ``own`` ones in front."""
    parts = [f"{n} AS MATERIALIZED ({CTES[n]})" for n in _used(f"{body} {own}")]
    if own:
        parts.append(own.strip())
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body.strip()


# --- Spark side -------------------------------------------------------------


def docs(spark: SparkSession, d: str) -> DataFrame:
    return corpus.dedup(readers.read_documents(spark, d))


_INDEXES: dict = {}


def index(spark: SparkSession, d: str) -> Index:
    """The index of one folder's documents, built table by table on first use in a session."""
    key = (spark.sparkContext.applicationId, d.rstrip("/"))
    if key not in _INDEXES:
        _INDEXES[key] = Index(spark, readers.read_documents(spark, d))
    return _INDEXES[key]


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return index(spark, d)["chunks"]


def questions(spark: SparkSession, d: str) -> DataFrame:
    return readers.read_questions(spark, d)


def bm25_hits(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    i = index(spark, d)
    return retrieve.bm25(questions(spark, d), i["postings"], i["stats"], k, rarity=i["rarity"])


def star_tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {t: readers.table(spark, d, t) for t in ("nation", "customer", "supplier", "orders", "lineitem")}


def purchase_edges(spark: SparkSession, d: str) -> DataFrame:
    """Customer-part edges of the star schema, weighted by the number of order lines."""
    orders = readers.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    lines = readers.table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("o_custkey", "l_partkey")
        .agg(F.count("*").alias("weight"))
        .select(
            F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"),
            F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"),
            "weight",
        )
    )


def hits_out(hits: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    return hits.select("q_id", id_col, F.col("score"), F.col("rank").cast("int").alias("rank"), "via")


# --- SQL side ---------------------------------------------------------------

cte("udocs", "SELECT * FROM documents WHERE doc_id IN (SELECT min(doc_id) FROM documents GROUP BY sha256(text))")
cte("doc_pieces", r"SELECT doc_id, lang, source, regexp_extract_all(text, '\S{1,64}') AS p FROM udocs")
cte(
    "chunks",
    """
    SELECT doc_id || ':' || i AS chunk_id, doc_id, i::INTEGER AS chunk_no, lang, source,
           array_to_string(p[i * 48 + 1 : i * 48 + 64], ' ') AS text
    FROM (SELECT *, unnest(range(0, greatest(CAST(ceil((len(p) - 64) / 48.0) AS BIGINT), 0) + 1)) AS i
          FROM doc_pieces WHERE len(p) > 0)
    """,
)
cte("chunk_toks", r"SELECT chunk_id, doc_id, regexp_extract_all(lower(text), '\p{L}+') AS t FROM chunks")
cte("posts", """
    SELECT term, chunk_id, dl, count(*) AS tf
    FROM (SELECT chunk_id, len(t) AS dl, unnest(t) AS term FROM chunk_toks) GROUP BY ALL""")
cte("stats", "SELECT count(*) AS n, avg(len(t)) AS avgdl FROM chunk_toks")
cte("chunk_df", "SELECT term, count(*) AS df FROM posts GROUP BY term")
cte("qs", "SELECT item_id AS q_id, text FROM benchmark")
cte("qterms", r"SELECT DISTINCT q_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS term FROM qs")
cte("bm25_scores", """
    SELECT q_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) *
           (tf * 2.2) / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
    FROM qterms JOIN posts USING (term) JOIN chunk_df USING (term), stats
    GROUP BY q_id, chunk_id""")
cte("bm25_ranked", """
    SELECT q_id, chunk_id, score,
           row_number() OVER (PARTITION BY q_id ORDER BY score DESC, chunk_id)::INTEGER AS rank
    FROM bm25_scores""")
cte("bm25_hits", "SELECT *, 'bm25' AS via FROM bm25_ranked WHERE rank <= 10")
cte("ments", r"""
    SELECT entity, chunk_id, count(*) AS n
    FROM (SELECT chunk_id, unnest(t) AS entity FROM chunk_toks)
    WHERE entity IN (
        SELECT e FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS e FROM udocs)
        WHERE length(e) >= 5 GROUP BY e HAVING count(*) >= 5)
    GROUP BY ALL""")
cte("edges", """
    SELECT a.entity AS src, b.entity AS dst, count(*) AS weight
    FROM ments a JOIN ments b ON a.chunk_id = b.chunk_id AND a.entity < b.entity
    GROUP BY ALL HAVING count(*) >= 2""")
cte("both_ways", "SELECT src, dst, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges")
cte("ment_weights", """
    SELECT entity, chunk_id, n, (1 + ln(n)) * ln(1 + (SELECT n FROM stats) / df) AS weight
    FROM ments JOIN (SELECT entity, count(*) AS df FROM ments GROUP BY entity) USING (entity)""")
cte("buys", """
    SELECT 'c' || o_custkey AS src, 'p' || l_partkey AS dst, count(*) AS weight
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""")
cte("buys_both", "SELECT src, dst, weight FROM buys UNION ALL SELECT dst, src, weight FROM buys")
cte("facts", """
    SELECT 'nation:' || n_nationkey AS src, 'in_region' AS rel, 'region:' || n_regionkey AS dst, count(*) AS weight FROM nation GROUP BY ALL
    UNION ALL SELECT 'customer:' || c_custkey, 'in_nation', 'nation:' || c_nationkey, count(*) FROM customer GROUP BY ALL
    UNION ALL SELECT 'supplier:' || s_suppkey, 'in_nation', 'nation:' || s_nationkey, count(*) FROM supplier GROUP BY ALL
    UNION ALL SELECT 'order:' || o_orderkey, 'placed_by', 'customer:' || o_custkey, count(*) FROM orders GROUP BY ALL
    UNION ALL SELECT 'order:' || l_orderkey, 'has_part', 'part:' || l_partkey, count(*) FROM lineitem GROUP BY ALL
    UNION ALL SELECT 'part:' || l_partkey, 'supplied_by', 'supplier:' || l_suppkey, count(*) FROM lineitem GROUP BY ALL""")


def propagation(edge_table: str, rounds: int, prefix: str) -> str:
    """CTE text of synchronous label propagation; the last one is ``{prefix}{rounds}``."""
    parts = [
        f"{prefix}0 AS MATERIALIZED (SELECT DISTINCT node, node AS community FROM "
        f"(SELECT src AS node FROM {edge_table} UNION ALL SELECT dst FROM {edge_table}))"
    ]
    for r in range(1, rounds + 1):
        parts.append(
            f"{prefix}{r} AS MATERIALIZED (SELECT node, arg_min(community, (-w, community)) AS community FROM ("
            f"SELECT e.dst AS node, s.community, round(sum(e.weight::DOUBLE), 9) AS w "
            f"FROM {edge_table} e JOIN {prefix}{r - 1} s ON s.node = e.src GROUP BY ALL) GROUP BY node)"
        )
    return ",\n".join(parts)


def min_labels(edge_table: str, node_table: str, rounds: int, prefix: str) -> str:
    """CTE text of minimum label spreading over both-way edges, with a jump to the
    label's own label each round. ``settled`` must read the result: it fails if the last round changed a label."""
    parts = [f"{prefix}0 AS MATERIALIZED (SELECT DISTINCT node, node AS label FROM {node_table})"]
    for r in range(1, rounds + 1):
        p = f"{prefix}{r - 1}"
        parts.append(
            f"{prefix}{r} AS MATERIALIZED (SELECT s.node, least(min(s.label), min(j.label)) AS label FROM ("
            f"SELECT s.node, least(s.label, coalesce(min(t.label), s.label)) AS label FROM {p} s "
            f"LEFT JOIN {edge_table} e ON e.dst = s.node LEFT JOIN {p} t ON t.node = e.src "
            f"GROUP BY s.node, s.label) s JOIN {p} j ON j.node = s.label GROUP BY s.node)"
        )
    return ",\n".join(parts)


def settled(prefix: str, rounds: int) -> str:
    """A derived table of ``(node, label)`` of the last round of ``min_labels``, an error if it was not the end."""
    return (
        f"(SELECT a.node, CASE WHEN a.label = b.label THEN a.label ELSE error('labels not settled after {rounds} rounds') END AS label "
        f"FROM {prefix}{rounds} a JOIN {prefix}{rounds - 1} b USING (node))"
    )


def register(parts: str) -> None:
    """Register the expressions of a generated chain one by one."""
    for part in re.split(r",\n(?=\w+ AS MATERIALIZED)", parts):
        name, sql = part.split(" AS MATERIALIZED ", 1)
        cte(name, sql.strip()[1:-1])


cte("qents", "SELECT DISTINCT q_id, term AS node FROM qterms WHERE term IN (SELECT entity FROM ments)")
cte("hop0", "SELECT q_id, node, 0 AS hop FROM qents")
cte("hop1", """
    SELECT DISTINCT h.q_id, e.dst AS node, 1 AS hop FROM hop0 h JOIN both_ways e ON e.src = h.node
    WHERE (h.q_id, e.dst) NOT IN (SELECT (q_id, node) FROM hop0)""")
cte("hop2", """
    SELECT DISTINCT h.q_id, e.dst AS node, 2 AS hop FROM hop1 h JOIN both_ways e ON e.src = h.node
    WHERE (h.q_id, e.dst) NOT IN (SELECT (q_id, node) FROM hop0)
      AND (h.q_id, e.dst) NOT IN (SELECT (q_id, node) FROM hop1)""")
register(propagation("both_ways", 3, "lp"))
cte("member", "SELECT node, community FROM lp3")
cte("upper_edges", """
    SELECT a.community AS src, b.community AS dst, sum(weight)::DOUBLE AS weight
    FROM both_ways JOIN member a ON a.node = src JOIN member b ON b.node = dst
    WHERE a.community <> b.community GROUP BY ALL""")
register(propagation("upper_edges", 3, "up"))
cte("levels", """
    SELECT node, 0::INTEGER AS level, community FROM member
    UNION ALL
    SELECT m.node, 1, coalesce(u.community, m.community) FROM member m LEFT JOIN up3 u ON u.node = m.community""")
