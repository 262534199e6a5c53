from __future__ import annotations

from pyspark.sql import functions as F

from catalog import base, retrieval
from catalog.base import cte, with_ctes
from lodeweave.operators import agent, ordered
from lodeweave.session import new_path
from lodeweave.sources import readers

QUERIES: dict = {}
SQL: dict = {}


def route_questions(spark, d):
    i = base.index(spark, d)
    return agent.route(base.questions(spark, d), i["rarity"], i["mentions"])


def decompose_questions(spark, d):
    return agent.decompose(base.questions(spark, d))


def iterative_retrieve(spark, d):
    i = base.index(spark, d)
    return agent.iterate(base.questions(spark, d), i["postings"], i["stats"], 2, 5, 3, rarity=i["rarity"])


def conversation_memory(spark, d):
    return agent.memory(readers.read_turns(spark, d), 120)


def as_of_memory(spark, d):
    """The latest view of each user before each purchase."""
    e = readers.read_events(spark, d)
    buys = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    views = e.where("event_type = 'view'").select("event_id", "user_id", "ts", "value")
    out = ordered.as_of(buys, views, "user_id", "ts", ["event_id", "value"])
    return out.select(
        "event_id", "user_id", F.col("fact_ts").cast("timestamp_ntz").alias("fact_ts"), "fact_event_id", "fact_value"
    )


def contextual_question(spark, d):
    return agent.contextualize(readers.read_turns(spark, d), 2)


def step_trace(spark, d):
    steps = {"bm25": iterative_retrieve(spark, d), "local": retrieval.local_hits(spark, d)}
    return agent.log_trace(agent.trace(steps, route_questions(spark, d)), new_path(spark, "trace"), 1)


for _f in (
    route_questions, decompose_questions, iterative_retrieve, conversation_memory, as_of_memory,
    contextual_question, step_trace,
):
    QUERIES[_f.__name__] = _f

cte("routes", """
SELECT *, CASE WHEN n_entities >= 2 THEN 'local' WHEN n_terms >= 30 THEN 'global' WHEN n_known > 0 THEN 'text' ELSE 'vector' END AS route
FROM (SELECT q_id, (SELECT count(*) FROM qterms t WHERE t.q_id = q.q_id) AS n_terms,
             (SELECT count(*) FROM qterms t JOIN chunk_df USING (term) WHERE t.q_id = q.q_id) AS n_known,
             (SELECT count(*) FROM qents e WHERE e.q_id = q.q_id) AS n_entities FROM qs q)""")
SQL["route_questions"] = with_ctes("SELECT * FROM routes")
SQL["decompose_questions"] = r"""
SELECT q_id, part, q_id || '.' || part AS sub_id, text FROM (
  SELECT q_id, (i - 1)::INTEGER AS part, trim(regexp_replace(ps[i], '[ \t\r\n\f]+', ' ', 'g')) AS text FROM (
    SELECT q_id, ps, unnest(range(1, len(ps) + 1)) AS i
    FROM (SELECT item_id AS q_id, string_split_regex(text, '[.?!;\n]+') AS ps FROM benchmark)))
WHERE text <> ''"""
cte("it_first", "SELECT * FROM bm25_ranked WHERE rank <= 5")
cte("it_asked", """
    SELECT q_id, term FROM qterms UNION ALL
    SELECT q_id, term FROM (
      SELECT q_id, term, row_number() OVER (PARTITION BY q_id ORDER BY count(*) DESC, sum(tf), term) AS r
      FROM it_first JOIN posts USING (chunk_id) ANTI JOIN qterms USING (q_id, term) GROUP BY q_id, term) WHERE r <= 3""")
cte("it_second", """
    SELECT q_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) *
           (tf * 2.2) / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
    FROM it_asked JOIN posts USING (term) JOIN chunk_df USING (term), stats GROUP BY q_id, chunk_id""")
cte("it_hits", """
    SELECT q_id, 1::INTEGER AS round, chunk_id, score, rank FROM it_first
    UNION ALL SELECT q_id, 2::INTEGER, chunk_id, score, place FROM (
      SELECT q_id, chunk_id, score, row_number() OVER (PARTITION BY q_id ORDER BY r)::INTEGER AS place
      FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, chunk_id) AS r FROM it_second) WHERE r <= 10)
      ANTI JOIN it_first USING (q_id, chunk_id)) WHERE place <= 5""")
SQL["iterative_retrieve"] = with_ctes("SELECT q_id, round, chunk_id, score, rank FROM it_hits")
SQL["conversation_memory"] = r"""
SELECT * FROM (
  SELECT conv_id, turn, role, n_pieces,
         sum(CASE WHEN role = 'system' THEN 0 ELSE n_pieces END) OVER (PARTITION BY conv_id ORDER BY turn DESC)::BIGINT AS used
  FROM (SELECT *, len(regexp_extract_all(text, '\S{1,64}'))::INTEGER AS n_pieces FROM conversations))
WHERE role = 'system' OR used <= 120"""
SQL["as_of_memory"] = """
SELECT p.event_id, p.user_id, v.ts AS fact_ts, v.event_id AS fact_event_id, v.value AS fact_value
FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON v.user_id = p.user_id AND v.ts <= p.ts"""
SQL["contextual_question"] = r"""
WITH t AS (SELECT *, regexp_extract_all(lower(text), '\p{L}+') AS ts FROM conversations)
SELECT conv_id, turn, text, coalesce(array_to_string(list_sort(list_filter(list_distinct(before), lambda x: NOT list_contains(ts, x))), ' '), '') AS context
FROM (SELECT u.conv_id, u.turn, any_value(u.text) AS text, any_value(u.ts) AS ts, flatten(list(b.ts) FILTER (WHERE b.turn IS NOT NULL)) AS before
      FROM t u LEFT JOIN t b ON b.conv_id = u.conv_id AND b.turn BETWEEN u.turn - 2 AND u.turn - 1 WHERE u.role = 'user' GROUP BY ALL)"""
SQL["step_trace"] = with_ctes("""
SELECT q_id, round, step, route, count(*) AS n_hits, max(score) AS best, sum((r = 1)::INTEGER)::BIGINT AS gain, 1::BIGINT AS run FROM (
  SELECT *, row_number() OVER (PARTITION BY q_id, chunk_id ORDER BY round, no) AS r FROM (
    SELECT q_id, round, 0 AS no, 'bm25' AS step, chunk_id, score FROM it_hits
    UNION ALL SELECT q_id, 1::INTEGER, 1, 'local', chunk_id, score FROM local_hits))
JOIN routes USING (q_id) GROUP BY ALL""")
