from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import with_ctes
from lodeweave import session
from lodeweave.operators import retrieve
from lodeweave.sources import index, readers

from catalog import base

QUERIES: dict = {}
SQL: dict = {}


def scan_documents(spark, d):
    return readers.read_documents(spark, d, lang=["en", "fr"], source=["src1", "src2", "src3"])


def scan_pages(spark, d):
    return readers.read_pages(spark, d).drop("html")


def scan_conversations(spark, d):
    return readers.read_turns(spark, d, ["user", "assistant"])


def scan_embeddings(spark, d):
    v = readers.read_vectors(spark, d, 64)
    return v.select("vec_id", "label", F.size("embedding").alias("dim"), F.round(F.element_at("embedding", 1).cast("double"), 6).alias("first"))


def write_index(spark, d):
    """Postings written sorted by term, in folders per first hex digit of the term's hash, and read back."""
    path = session.new_path(spark, "postings")
    post = retrieve.postings(base.chunks(spark, d)).withColumn("part", F.substring(F.md5("term"), 1, 1))
    index.write_index(post, path, keys=["part", "term", "chunk_id"], by=["part"])
    back = index.read_index(spark, path, post.schema)
    return back.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


QUERIES.update(
    scan_documents=scan_documents,
    scan_pages=scan_pages,
    scan_conversations=scan_conversations,
    scan_embeddings=scan_embeddings,
    write_index=write_index,
)
SQL["scan_documents"] = "SELECT * FROM documents WHERE lang IN ('en', 'fr') AND source IN ('src1', 'src2', 'src3')"
SQL["scan_pages"] = r"""
SELECT page_id, url, regexp_extract(url, '^([a-z]+)://', 1) AS scheme,
       regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host,
       regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path,
       nullif(regexp_extract(url, '\?([^#]*)', 1), '') AS query,
       nullif(regexp_extract(url, '#(.*)$', 1), '') AS fragment
FROM pages"""
SQL["scan_conversations"] = "SELECT * FROM conversations WHERE role IN ('user', 'assistant')"
SQL["scan_embeddings"] = """
SELECT vec_id, label, len(embedding)::INTEGER AS dim, round(embedding[1]::DOUBLE, 6) AS first
FROM embeddings WHERE len(embedding) = 64"""
SQL["write_index"] = with_ctes("SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf FROM posts GROUP BY term")
