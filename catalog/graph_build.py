from __future__ import annotations

from pyspark.sql import functions as F

from catalog import base
from catalog.base import min_labels, settled, with_ctes
from lodeweave.operators import graph_build as gb
from lodeweave.operators import retrieve
from lodeweave.sources import readers

QUERIES: dict = {}
SQL: dict = {}


def typed_mentions(spark, d):
    return gb.typed_mentions(base.docs(spark, d))


def gazetteer_mentions(spark, d):
    pages = readers.table(spark, d, "pages", readers.PAGES)
    parts = readers.table(spark, d, "part").select(F.col("p_name").alias("name"))
    return gb.gazetteer_mentions(base.chunks(spark, d), gb.link_names(pages).union(parts))


def term_entities(spark, d):
    return gb.term_entities(base.chunks(spark, d), base.docs(spark, d))


def entity_normalize(spark, d):
    return gb.normalize(gb.surface_forms(base.chunks(spark, d)))


def entity_resolve(spark, d):
    # The names of the mentions: entities that are terms of chunks.
    i = base.index(spark, d)
    seen = retrieve.term_rarity(i["chunks"]).select(F.col("term").alias("entity"))
    return gb.resolve(gb.entity_band(i.docs).join(seen, "entity", "left_semi"))


def cooccurrence_edges(spark, d):
    i = base.index(spark, d)
    return gb.cooccur(i["mentions"], ids=i["names"])


def pmi_edges(spark, d):
    m, ids = base.index(spark, d)["mentions"], base.index(spark, d)["names"]
    of = m.join(ids, "entity").select(F.col("id").alias("entity"), "chunk_id")
    out = gb.with_names(gb.pmi(gb.id_pairs(m, ids), of, base.chunks(spark, d)), ids, "src", "dst")
    return out.withColumn("pmi", F.round("pmi", 6))


def link_edges(spark, d):
    out = gb.links(readers.table(spark, d, "pages", readers.PAGES))
    return out.withColumn("weight", F.round("weight", 6))


def table_triples(spark, d):
    return gb.triples(base.star_tables(spark, d))


def chunk_entity_edges(spark, d):
    out = gb.mention_edges(base.index(spark, d)["mentions"], base.chunks(spark, d))
    return out.withColumn("weight", F.round("weight", 6))


for _f in (
    typed_mentions, gazetteer_mentions, term_entities, entity_normalize, entity_resolve,
    cooccurrence_edges, pmi_edges, link_edges, table_triples, chunk_entity_edges,
):
    QUERIES[_f.__name__] = _f

SQL["typed_mentions"] = with_ctes("""
SELECT kind || ':' || lower(m) AS entity, kind, doc_id || ':' || no AS chunk_id, count(*) AS n
FROM begun, unnest(range(greatest(0, ceil((spot - 63) / 48.0))::BIGINT, least(spot // 48, last)::BIGINT + 1)) r(no) GROUP BY ALL""",
r"""
kinds(kind, rx) AS (VALUES ('email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}'), ('url', 'https?://[A-Za-z0-9./?=&_%#-]+'), ('number', '[0-9]{6,}')),
ws AS (SELECT doc_id, regexp_extract_all(text, '\S+') AS ws FROM udocs),
word AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM ws),
spaced AS (SELECT doc_id, w, i, ceil(length(w) / 64.0)::BIGINT AS n FROM word),
set_out AS (SELECT doc_id, w, sum(n) OVER (PARTITION BY doc_id ORDER BY i) - n AS before, sum(n) OVER (PARTITION BY doc_id) AS pieces FROM spaced),
hit AS (SELECT doc_id, before, pieces, w, kind, unnest(regexp_extract_all(w, rx)) AS m FROM set_out, kinds),
begun AS (SELECT doc_id, kind, m, (before + (instr(w, m) - 1) // 64)::BIGINT AS spot, greatest(ceil((pieces - 64) / 48.0), 0)::BIGINT AS last FROM hit)""")
SQL["gazetteer_mentions"] = with_ctes(r"""
SELECT entity, chunk_id, count(*) AS n FROM (
  SELECT chunk_id, unnest(t) AS entity FROM chunk_toks
  UNION ALL SELECT chunk_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM chunk_toks
  UNION ALL SELECT chunk_id, unnest(list_transform(range(1, greatest(len(t) - 1, 1)), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) FROM chunk_toks)
WHERE entity IN (
  SELECT array_to_string(regexp_extract_all(lower(name), '\p{L}+'), ' ') FROM (
    SELECT unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)) AS name FROM pages UNION ALL SELECT p_name FROM part))
  AND entity <> ''
GROUP BY ALL""")
SQL["term_entities"] = with_ctes("SELECT entity, chunk_id, n FROM ments")
SQL["entity_normalize"] = with_ctes(r"""
SELECT entity, arg_min(form, (-n, form)) AS form, count(*) AS n_forms, sum(n)::BIGINT AS n FROM (
  SELECT regexp_replace(translate(lower(form), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^\p{L}\p{N}]', '', 'g') AS entity,
         form, count(*) AS n
  FROM (SELECT unnest(regexp_extract_all(text, '\p{L}+')) AS form FROM chunks) WHERE length(form) >= 5 GROUP BY ALL)
WHERE entity <> '' GROUP BY entity""")
SQL["entity_resolve"] = with_ctes(
    f"SELECT node AS entity, label AS canonical FROM {settled('lab', 40)}",
    # DuckDB compares bytes, so accented letters are mapped to single bytes first.
    """names AS MATERIALIZED (SELECT DISTINCT entity AS node, length(entity) AS l,
  translate(entity, 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿß', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ01') AS b FROM ments),
close AS MATERIALIZED (SELECT a.node AS src, b.node AS dst FROM names a JOIN names b
  ON a.l BETWEEN b.l - 1 AND b.l + 1 AND a.node <> b.node WHERE levenshtein(a.b, b.b) = 1),
""" + min_labels("close", "names", 40, "lab"),
)
SQL["cooccurrence_edges"] = with_ctes("SELECT src, dst, weight FROM edges")
SQL["pmi_edges"] = with_ctes("""
SELECT src, dst, weight, round(ln(weight * (SELECT n FROM stats) / (a.m * b.m)), 6) AS pmi
FROM edges JOIN (SELECT entity, count(*) AS m FROM ments GROUP BY entity) a ON a.entity = src
JOIN (SELECT entity, count(*) AS m FROM ments GROUP BY entity) b ON b.entity = dst""")
SQL["link_edges"] = """
WITH l AS (SELECT page_id, target, count(*) AS n FROM (
    SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages) GROUP BY ALL)
SELECT 'page:' || page_id AS src, 'links' AS rel, 'target:' || target AS dst, n,
       round(ln(1 + (SELECT count(*) FROM pages) / df), 6) AS weight
FROM l JOIN (SELECT target, count(*) AS df FROM l GROUP BY target) USING (target)"""
SQL["table_triples"] = with_ctes("SELECT src, rel, dst, weight FROM facts")
SQL["chunk_entity_edges"] = with_ctes("SELECT entity, chunk_id, n, round(weight, 6) AS weight FROM ment_weights")
