"""The registered query of each operator, and the SQL that checks it where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodeweave.llm import cross_parse, hard_negatives, html_main, mixing, neighbours, pieces_bpe, quality, repeats, shards, simhash, surrogates, turn_trie, word_bpe
from lodeweave.llm.common import read

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORD_PIECES = public_tokenizers.path("word_bpe_49k.json")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(read(spark, sf_dir, "documents")).drop("kept_text")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(read(spark, sf_dir, "pages"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces_bpe.encode(read(spark, sf_dir, "documents"), PIECES).drop("ids_text", "decoded")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.hide(read(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_parse.identify(read(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(read(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(read(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard(read(spark, sf_dir, "documents"))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(read(spark, sf_dir, "embeddings"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_trie.trie(read(spark, sf_dir, "conversations"))


def op12_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe.encode(read(spark, sf_dir, "documents"), WORD_PIECES, whole=False)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_substring_dedup, op2_html_extraction, op3_sentencepiece, op4_pii, op5_language_id, op6_quality_rules, op7_mixing, op8_simhash, op9_sharding, op10_nearest_neighbours,
        op11_conversation_trie, op12_word_bpe, op13_hard_negatives,
    )
}  # fmt: skip

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

_OP1 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 34], ' ') AS k FROM d, unnest(range(1, len(w) - 33)) t(i)),
twice AS (SELECT k FROM win GROUP BY k HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, i + o AS pos FROM win JOIN twice USING (k), range(35) r(o)),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS pos FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY pos) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, len(w)::BIGINT - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

# The rules on a table with columns doc_id, text, lang, source; used for the pipeline too.
QUALITY = rf"""
q_d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, {_WORDS} AS w FROM q_in),
q_win AS (SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS k FROM q_d, unnest(range(1, len(w) - 6)) t(i)),
q_twice AS (SELECT doc_id, k FROM q_win GROUP BY doc_id, k HAVING count(*) > 1),
q_rep AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM q_win JOIN q_twice USING (doc_id, k), range(8) r(o) GROUP BY doc_id),
q_line AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM q_d),
q_base AS (
  SELECT doc_id, coalesce('=' || lang, 'null') AS kl, coalesce('=' || source, 'null') AS ks, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM q_d JOIN q_line USING (doc_id) LEFT JOIN q_rep USING (doc_id)),
q_all AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM q_base),
q_ratio AS (
  SELECT doc_id, kl, ks, base_failed, unnest(['symbols', 'length', 'lines', 'repeats']) AS metric,
    unnest([1000 * n_symbols // greatest(n_words, 1), 100 * word_chars // greatest(n_words, 1), 1000 * n_dup_lines // greatest(n_lines, 1), 1000 * n_repeat_words // greatest(n_words, 1)]) AS v
  FROM q_all),
q_fine AS (SELECT kl, ks, metric, v - v % (1::BIGINT << greatest(length(bin(v)) - 7, 0)) AS value, count(*) AS n FROM q_ratio WHERE NOT base_failed GROUP BY ALL),
q_sketch AS (
  SELECT kl, ks, metric, value, sum(n) AS n FROM (
    SELECT * FROM q_fine UNION ALL SELECT kl, '*', metric, value, n FROM q_fine UNION ALL SELECT '*', '*', metric, value, n FROM q_fine) GROUP BY ALL),
q_cum AS (SELECT *, sum(n) OVER (PARTITION BY kl, ks, metric ORDER BY value) AS upto, sum(n) OVER (PARTITION BY kl, ks, metric) AS every FROM q_sketch),
q_quart AS (SELECT kl, ks, metric, max(every) AS n, min(value) FILTER (4 * upto >= every) AS q1, min(value) FILTER (4 * upto >= 3 * every) AS q3 FROM q_cum GROUP BY ALL),
q_pick AS (
  SELECT f.kl, f.ks, f.metric, CASE WHEN f.n >= 100 THEN f.q1 WHEN l.n >= 100 THEN l.q1 ELSE a.q1 END AS q1, CASE WHEN f.n >= 100 THEN f.q3 WHEN l.n >= 100 THEN l.q3 ELSE a.q3 END AS q3
  FROM q_quart f JOIN q_quart l ON l.kl = f.kl AND l.ks = '*' AND l.metric = f.metric JOIN q_quart a ON a.kl = '*' AND a.metric = f.metric WHERE f.ks <> '*'),
q_fence AS (SELECT kl, ks, metric, 3 * (q3 - q1) + CASE metric WHEN 'lines' THEN 300 ELSE 150 END AS reach, q1, q3 FROM q_pick),
q_in_all AS (SELECT r.doc_id, bool_and(coalesce(v BETWEEN q1 - reach AND q3 + reach, false)) AS inside FROM q_ratio r LEFT JOIN q_fence USING (kl, ks, metric) GROUP BY r.doc_id),
q_out AS (SELECT q_all.*, NOT base_failed AND inside AS kept FROM q_all JOIN q_in_all USING (doc_id))
"""

_OP6 = f"""
WITH q_in AS (SELECT * FROM documents), {QUALITY}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM q_out
"""

_OP7 = rf"""
WITH d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size FROM documents),
u AS (SELECT *, length(bin(size)) AS bits, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || size::VARCHAR), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656::DOUBLE AS u FROM d),
s AS (SELECT source, sum(size)::BIGINT AS s, sum(size * bits)::BIGINT AS sb FROM u GROUP BY source),
k AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM s),
c AS (SELECT *, [5, 2, 1][k % 3 + 1]::DOUBLE AS w, 2 * s AS most FROM k),
l AS (SELECT *, (1.5::DOUBLE * sum(s) OVER () - coalesce(sum(most) OVER (ORDER BY most / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY most / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
t AS (SELECT *, least(most::DOUBLE, coalesce((SELECT max(level) FROM l WHERE level * w <= most) * w, most::DOUBLE)) AS target FROM c),
g AS (SELECT *, CASE WHEN s > 0 THEN floor(target / s)::INT ELSE 0 END AS copies FROM t),
r AS (SELECT *, target - copies * s AS rest, CASE WHEN sb > 0 THEN (target - copies * s) / sb ELSE 0 END AS pull FROM g),
m AS (SELECT u.*, s, target, copies, rest, least(1, pull * bits) AS p FROM u JOIN r ON u.source IS NOT DISTINCT FROM r.source),
o AS (SELECT *, CASE WHEN p >= 1 THEN 0 WHEN p <= 0 THEN 'inf'::DOUBLE ELSE (u / (1 - u)) / (p / (1 - p)) END AS rank FROM m),
b AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o)
SELECT doc_id, size, s AS source_size, target, ((copies + (2 * before + size <= 2 * rest)::INT) * size)::BIGINT AS taken FROM b
"""

# CRC-32 by its polynomial, bit by bit, over the decimal digits of the id.
_DIGITS = "list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)"
_BIT = "CASE WHEN b & 1 = 1 THEN xor(b >> 1, 3988292384) ELSE b >> 1 END"
_CRC = f"xor(list_reduce({_DIGITS}, lambda a, x: list_reduce(range(8), lambda b, i: {_BIT}, xor(a, x)), 4294967295::BIGINT), 4294967295::BIGINT)"

_OP11 = rf"""
WITH t AS (SELECT conv_id, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS turn_, turn FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(turn_ ORDER BY turn NULLS FIRST, turn_.role, turn_.text) AS s FROM t GROUP BY conv_id),
shared AS (SELECT *, ({_CRC} % 4)::BIGINT AS h FROM own),
rebuilt AS (SELECT c.conv_id, list_concat(coalesce(b.s[1 : c.h], []), c.s[c.h + 1 :]) AS s FROM shared c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 20),
prefix AS (SELECT conv_id, len(s) AS size, d, s[1 : d] AS p, s[1 : d - 1] AS up FROM rebuilt, unnest(range(len(s) + 1)) r(d)),
node AS (
  SELECT p, d AS depth, min(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = d), '')) AS ends_sha256,
    CASE WHEN d = 0 THEN 0 ELSE len(list_filter(regexp_split_to_array(p[d].text, '[ 	-]+'), lambda x: x <> '')) END * (count(*) - 1) AS saved
  FROM prefix GROUP BY p, d),
kids AS (SELECT up, depth - 1 AS depth, count(*) AS n FROM node WHERE depth > 0 GROUP BY ALL),
under AS (
  SELECT a.p, a.depth, sum(b.saved) AS saved, count(*) FILTER (k.n IS NULL) AS leaves
  FROM node a JOIN node b ON b.depth >= a.depth AND b.p[1 : a.depth] = a.p LEFT JOIN kids k ON k.up = b.p AND k.depth = b.depth GROUP BY a.p, a.depth)
SELECT node.conv_id, node.depth::BIGINT AS depth, parent.conv_id AS parent_conv_id, node.n_convs::BIGINT AS n_convs, coalesce(kids.n, 0)::BIGINT AS n_children, under.leaves::BIGINT AS n_leaves,
  under.saved::BIGINT AS saved_tokens, node.ends_sha256
FROM node JOIN under USING (p, depth) LEFT JOIN kids ON kids.up = node.p AND kids.depth = node.depth LEFT JOIN node parent ON node.depth > 0 AND parent.p = node.up AND parent.depth = node.depth - 1
"""

_OP13 = """
WITH r AS (
  SELECT vec_id, min({'label': CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END::BIGINT, 'v': list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT)}) AS r
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.r.label = b.r.label AS same, coalesce(list_sum(list_transform(list_zip(a.r.v, b.r.v), lambda p: p[1] * p[2])), 0)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.r.v) = len(b.r.v)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score QUALIFY rank <= 5
"""

SQL = {"op1_substring_dedup": _OP1, "op6_quality_rules": _OP6, "op7_mixing": _OP7, "op11_conversation_trie": _OP11, "op13_hard_negatives": _OP13}
