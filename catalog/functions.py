from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from catalog import base
from catalog.base import with_ctes
from catalog.corpus import SQL as CORPUS_SQL
from lodeweave.functions import udfs
from lodeweave.sources import readers

QUERIES: dict = {}
SQL: dict = {}


def chunk_udtf(spark, d):
    udfs.register_all(spark)
    readers.read_documents(spark, d).createOrReplaceTempView("lw_documents")
    return spark.sql(
        "SELECT concat_ws(':', d.doc_id, c.chunk_no) AS chunk_id, d.doc_id, c.chunk_no, c.text "
        "FROM lw_documents d, LATERAL chunk_text(d.text, 64, 48) c"
    )


def letter_counts(texts: list[str]) -> np.ndarray:
    """Stand-in embedding: how often each letter a-z occurs."""
    return np.array([[t.count(chr(97 + i)) for i in range(26)] for t in texts], dtype=float).reshape(-1, 26)


def embed_udf(spark, d):
    embed = udfs.embed_udf(letter_counts)
    out = readers.read_documents(spark, d).select("doc_id", F.posexplode(embed("text")).alias("dim", "value"))
    return out


def vector_mean_udaf(spark, d):
    out = udfs.vector_mean(readers.read_vectors(spark, d), "label")
    return out.select("label", "n", F.posexplode("mean").alias("i", "m")).withColumn("m", F.round("m", 6))


def register_all(spark, d):
    """The registered functions in SQL: similarity of each vector to its label's mean."""
    udfs.register_all(spark)
    readers.read_vectors(spark, d).createOrReplaceTempView("lw_vectors")
    udfs.vector_mean(readers.read_vectors(spark, d), "label").createOrReplaceTempView("lw_means")
    return spark.sql(
        "SELECT v.vec_id, round(lw_cosine(CAST(v.embedding AS ARRAY<DOUBLE>), m.mean), 6) AS sim, "
        "round(lw_rrf(v.label, 60), 9) AS rrf FROM lw_vectors v JOIN lw_means m ON m.label = v.label"
    )


for _f in (chunk_udtf, embed_udf, vector_mean_udaf, register_all):
    QUERIES[_f.__name__] = _f

SQL["chunk_udtf"] = CORPUS_SQL["chunk_tokens"]
SQL["embed_udf"] = """
SELECT doc_id, i::INTEGER AS dim, (length(text) - length(replace(text, chr(97 + i::INTEGER), '')))::DOUBLE AS value
FROM documents, (SELECT unnest(range(0, 26)) AS i)"""
_MEAN = """
SELECT label, i, avg(embedding[i + 1]::DOUBLE) AS m, count(*) AS n
FROM embeddings, (SELECT unnest(range(0, 64)) AS i) GROUP BY ALL"""
SQL["vector_mean_udaf"] = f"SELECT label, n, i::INTEGER AS i, round(m, 6) AS m FROM ({_MEAN})"
SQL["register_all"] = f"""
WITH means AS (SELECT label, list(m ORDER BY i) AS mean FROM ({_MEAN}) GROUP BY label)
SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], mean) /
       (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(mean, mean))), 6) AS sim,
       round(1.0::DOUBLE / (60 + label), 9) AS rrf
FROM embeddings JOIN means USING (label)"""
