from __future__ import annotations

from pyspark.sql import functions as F

from catalog import base
from catalog.base import cte, min_labels, settled, with_ctes
from lodeweave.operators import corpus
from lodeweave.sources import readers

QUERIES: dict = {}
SQL: dict = {}


def page_text(spark, d):
    return corpus.page_text(readers.table(spark, d, "pages", readers.PAGES))


def exact_dedup(spark, d):
    return corpus.dedup(readers.read_documents(spark, d))


def near_dedup(spark, d):
    return corpus.near_clusters(readers.read_documents(spark, d))


def chunk_tokens(spark, d):
    return corpus.chunk(readers.read_documents(spark, d)).drop("lang", "source")


def chunk_paragraphs(spark, d):
    return corpus.chunk_paras(readers.read_documents(spark, d), 400)


def tokenize(spark, d):
    rows = corpus.tokens(readers.read_documents(spark, d))
    return rows.select(F.explode("tokens").alias("term")).groupBy("term").agg(F.count("*").alias("n"))


QUERIES.update(
    page_text=page_text,
    exact_dedup=exact_dedup,
    near_dedup=near_dedup,
    chunk_tokens=chunk_tokens,
    chunk_paragraphs=chunk_paragraphs,
    tokenize=tokenize,
)


def _decode(sql: str) -> str:
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        sql = f"replace({sql}, '{name}', '{char}')"
    return sql


_BODY = "html"
for _p in (
    r"(?is)<!--.*?-->",
    r"(?is)<script\b.*?</script\s*>",
    r"(?is)<style\b.*?</style\s*>",
    r"(?is)<head\b.*?</head\s*>",
    r"(?s)<[^>]*>",
):
    _BODY = f"regexp_replace({_BODY}, '{_p}', ' ', 'g')"

SQL["page_text"] = rf"""
SELECT page_id, url,
  trim(regexp_replace({_decode("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1)")}, '[ \t\r\n\f]+', ' ', 'g')) AS title,
  trim(regexp_replace({_decode(_BODY)}, '[ \t\r\n\f]+', ' ', 'g')) AS text
FROM pages"""
SQL["exact_dedup"] = with_ctes("SELECT * FROM udocs")

cte("shingled", r"""
    SELECT doc_id, list_distinct(list_transform(g, lambda x: ('0x' || md5(x)[1:8])::BIGINT)) AS s
    FROM (SELECT doc_id, CASE WHEN len(t) BETWEEN 1 AND 2 THEN [array_to_string(t, ' ')]
                 ELSE list_distinct(list_transform(range(1, greatest(len(t) - 1, 1)), lambda i: array_to_string(t[i : i + 2], ' '))) END AS g
          FROM (SELECT doc_id, regexp_extract_all(lower(text), '\p{L}+') AS t FROM udocs))
    WHERE len(g) > 0""")
_FAMILY = corpus.hash_family(48)
cte("sigs", f"""
    SELECT doc_id, list_transform(range(1, 49), lambda i: list_min(list_transform(s, lambda h:
        (h * ({[a for a, _ in _FAMILY]})[i] + ({[b for _, b in _FAMILY]})[i]) % {corpus.PRIME}))) AS sig FROM shingled""")
cte("bands", """
    SELECT doc_id, b || '-' || array_to_string(sig[b * 4 + 1 : b * 4 + 4], '-') AS bucket
    FROM (SELECT doc_id, sig, unnest(range(0, 12)) AS b FROM sigs)""")

_JACCARD = "len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)))"
_LEADERS = f"""
met AS MATERIALIZED (SELECT doc_id, bucket, head, n FROM bands JOIN (SELECT bucket, min(doc_id) AS head, count(*) AS n FROM bands GROUP BY bucket) USING (bucket) WHERE n > 1),
led AS MATERIALIZED (SELECT p.doc_id, p.head, {_JACCARD} AS j FROM (SELECT DISTINCT doc_id, head FROM met WHERE doc_id > head) p
  JOIN shingled a ON a.doc_id = p.doc_id JOIN shingled b ON b.doc_id = p.head),
mixed AS (SELECT DISTINCT bucket FROM met SEMI JOIN (SELECT * FROM led WHERE j < 0.7) f ON f.doc_id = met.doc_id AND f.head = met.head WHERE n > 2),
rest AS MATERIALIZED (SELECT * FROM shingled WHERE doc_id IN (SELECT doc_id FROM met JOIN mixed USING (bucket))),
near AS MATERIALIZED (SELECT doc_id AS src, head AS dst FROM led WHERE j >= 0.7 UNION
  SELECT a.doc_id, b.doc_id FROM rest a JOIN rest b ON a.doc_id > b.doc_id AND 10 * least(len(a.s), len(b.s)) >= 7 * greatest(len(a.s), len(b.s)) WHERE {_JACCARD} >= 0.7),
near_both AS MATERIALIZED (SELECT src, dst FROM near UNION SELECT dst, src FROM near),
near_nodes AS MATERIALIZED (SELECT doc_id AS node FROM udocs)"""

SQL["near_dedup"] = with_ctes(
    f"SELECT node AS doc_id, label AS cluster FROM {settled('lab', 12)}",
    _LEADERS + ",\n" + min_labels("near_both", "near_nodes", 12, "lab"),
)
_RAW_PIECES = r"SELECT doc_id, regexp_extract_all(text, '\S{1,64}') AS p FROM documents"
SQL["chunk_tokens"] = f"""
SELECT doc_id || ':' || i AS chunk_id, doc_id, i::INTEGER AS chunk_no,
       array_to_string(p[i * 48 + 1 : i * 48 + 64], ' ') AS text
FROM (SELECT *, unnest(range(0, greatest(CAST(ceil((len(p) - 64) / 48.0) AS BIGINT), 0) + 1)) AS i
      FROM ({_RAW_PIECES}) WHERE len(p) > 0)"""
SQL["chunk_paragraphs"] = r"""
WITH paras AS (
  SELECT doc_id, i AS pos, ps[i] AS para
  FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ps FROM documents))
  WHERE trim(ps[i]) <> ''),
placed AS (
  SELECT *, floor(coalesce(sum(length(para)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 400)::INTEGER AS chunk_no
  FROM paras)
SELECT doc_id || ':' || chunk_no AS chunk_id, doc_id, chunk_no, string_agg(para, chr(10) ORDER BY pos) AS text
FROM placed GROUP BY doc_id, chunk_no"""
SQL["tokenize"] = r"""
SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '\p{L}+')) AS term FROM documents) GROUP BY term"""
