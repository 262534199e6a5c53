from __future__ import annotations

from pyspark.sql import functions as F

from catalog import base, context, retrieval
from catalog.base import cte, with_ctes
from lodeweave.operators import evaluate, retrieve, vectors
from lodeweave.session import cut

QUERIES: dict = {}
SQL: dict = {}


def truth(spark, d):
    return evaluate.passage_truth(base.questions(spark, d), base.docs(spark, d), 8)


def _doc_hits(spark, d):
    return retrieve.collapse(base.bm25_hits(spark, d)).select("q_id", "doc_id", "rank")


def passage_truth(spark, d):
    return truth(spark, d)


def recall_at_k(spark, d):
    out = evaluate.recall(_doc_hits(spark, d), truth(spark, d), 5)
    return out.withColumn("recall", F.round("recall", 6)).withColumn("precision", F.round("precision", 6))


def mrr(spark, d):
    return evaluate.mrr(_doc_hits(spark, d), truth(spark, d)).withColumn("rr", F.round("rr", 6))


def ndcg_at_k(spark, d):
    out = evaluate.ndcg(_doc_hits(spark, d), truth(spark, d), 5)
    return out.select("q_id", *[F.round(c, 6).alias(c) for c in ("dcg", "ideal", "ndcg")])


def ann_recall(spark, d):
    q, v = retrieval._vectors(spark, d)
    exact = cut(vectors.knn(q, v, 5))
    parts = [
        evaluate.ann_recall(vectors.ivf(q, v, 5), exact, 5).withColumn("via", F.lit("ivf")),
        evaluate.ann_recall(vectors.lsh(q, v, 5), exact, 5).withColumn("via", F.lit("lsh")),
    ]
    return parts[0].unionByName(parts[1]).withColumn("recall", F.round("recall", 6))


def context_coverage(spark, d):
    out = evaluate.coverage(context.packed(spark, d), truth(spark, d))
    return out.withColumn("coverage", F.round("coverage", 6))


for _f in (passage_truth, recall_at_k, mrr, ndcg_at_k, ann_recall, context_coverage):
    QUERIES[_f.__name__] = _f

_GRAMS = "list_distinct(list_transform(range(1, greatest(len(t) - 6, 1)), lambda i: array_to_string(t[i : i + 7], ' ')))"
cte("truth", rf"""
    SELECT q_id, doc_id, count(*) AS shared
    FROM (SELECT q_id, unnest({_GRAMS}) AS g FROM (SELECT q_id, regexp_extract_all(lower(text), '\p{{L}}+') AS t FROM qs))
    JOIN (SELECT doc_id, unnest({_GRAMS}) AS g FROM (SELECT doc_id, regexp_extract_all(lower(text), '\p{{L}}+') AS t FROM udocs)) USING (g)
    GROUP BY ALL""")
cte("doc_ranks", """
    SELECT q_id, doc_id, row_number() OVER (PARTITION BY q_id ORDER BY rank) AS rank FROM (
      SELECT q_id, split_part(chunk_id, ':', 1)::BIGINT AS doc_id, min(rank) AS rank FROM bm25_hits GROUP BY ALL)""")
SQL["passage_truth"] = with_ctes("SELECT q_id, doc_id, shared FROM truth")
SQL["recall_at_k"] = with_ctes("""
SELECT q_id, count(*) AS n_true, count(rank) AS n_found, round(count(rank) / count(*), 6) AS recall, round(count(rank) / 5, 6) AS precision
FROM truth LEFT JOIN (SELECT * FROM doc_ranks WHERE rank <= 5) USING (q_id, doc_id) GROUP BY q_id""")
SQL["mrr"] = with_ctes("""
SELECT q_id, min(rank)::INTEGER AS first_rank, round(coalesce(1 / min(rank), 0), 6)::DOUBLE AS rr
FROM truth LEFT JOIN doc_ranks USING (q_id, doc_id) GROUP BY q_id""")
SQL["ndcg_at_k"] = with_ctes("""
SELECT q_id, round(dcg, 6) AS dcg, round(ideal, 6) AS ideal, round(dcg / ideal, 6) AS ndcg FROM (
  SELECT q_id, coalesce(sum(1 / log2(rank + 1.0::DOUBLE)), 0)::DOUBLE AS dcg,
         list_sum(list_transform(range(1, least(count(*), 5) + 1), lambda i: 1 / log2(i + 1.0::DOUBLE))) AS ideal
  FROM truth LEFT JOIN (SELECT * FROM doc_ranks WHERE rank <= 5) USING (q_id, doc_id) GROUP BY q_id)""")
SQL["ann_recall"] = with_ctes("""
SELECT count(*) AS n_questions, round(avg(r), 6) AS recall, via FROM (
  SELECT via, q_id, avg((h.found IS NOT NULL)::INTEGER) AS r
  FROM (SELECT q_id, id, v.via FROM exact_hits, (SELECT unnest(['ivf', 'lsh']) AS via) v)
  LEFT JOIN (SELECT q_id, id, 'ivf' AS via, 1 AS found FROM ivf_hits UNION ALL SELECT q_id, id, 'lsh', 1 FROM lsh_hits) h USING (q_id, id, via)
  GROUP BY ALL) GROUP BY via""")
SQL["context_coverage"] = with_ctes("""
SELECT q_id, count(*) AS n_true, count(k.doc_id) AS n_kept, round(count(k.doc_id) / count(*), 6) AS coverage
FROM truth t LEFT JOIN (SELECT DISTINCT q_id, split_part(chunk_id, ':', 1)::BIGINT AS doc_id FROM packed) k USING (q_id, doc_id) GROUP BY q_id""")
