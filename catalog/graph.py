from __future__ import annotations

from pyspark.sql import functions as F

from catalog import base
from catalog.base import min_labels, settled, with_ctes
from lodeweave.operators import graph, graph_build, iterate, retrieve
from lodeweave.session import cut

QUERIES: dict = {}
SQL: dict = {}

#: Bound of forward push in the registered queries: mass missed per unit of a node's weight.
PPR_EPS = 1e-5


def _links(spark, d):
    return base.index(spark, d)["links"]


def _named(spark, d, rows, *columns):
    return graph_build.with_names(rows, base.index(spark, d)["names"], *columns)


def _member_ids(spark, d):
    """The members of the index's communities by ids."""
    i = base.index(spark, d)
    ids = i["names"]
    return cut(
        i["members"].join(ids.select(F.col("entity").alias("node"), "id"), "node")
        .join(ids.select(F.col("entity").alias("community"), F.col("id").alias("c")), "community")
        .select(F.col("id").alias("node"), F.col("c").alias("community"))
    )


def _seeds(spark, d):
    return retrieve.question_entities(base.questions(spark, d), base.index(spark, d)["names"])


def _seed_ids(spark, d):
    """The seeds by ids."""
    return cut(_seeds(spark, d).join(base.index(spark, d)["names"], F.col("node") == F.col("entity")).select("q_id", F.col("id").alias("node")))


def degree_stats(spark, d):
    return graph.degrees(base.purchase_edges(spark, d))


def triple_pattern(spark, d):
    """Orders with a part whose supplier sits in the customer's nation, in one region."""
    return graph.match(
        graph_build.triples(base.star_tables(spark, d)),
        [
            ("?n", "in_region", "region:1"),
            ("?c", "in_nation", "?n"),
            ("?o", "placed_by", "?c"),
            ("?o", "has_part", "?p"),
            ("?p", "supplied_by", "?s"),
            ("?s", "in_nation", "?n"),
        ],
        once=True,
    )


def k_hop(spark, d):
    return _named(spark, d, iterate.k_hop(_links(spark, d), _seed_ids(spark, d), 2, both=True), "node")


def connected_components(spark, d):
    # Ids go by the names, so the least id of a component is its least name.
    nodes = base.index(spark, d)["names"].select(F.col("id").alias("node"))
    return _named(spark, d, iterate.components_of_links(_links(spark, d), nodes), "node", "component")


def shortest_path(spark, d):
    ends = _seed_ids(spark, d).groupBy("q_id").agg(F.min("node").alias("src"), F.max("node").alias("dst"))
    pairs = ends.where("src <> dst").select("src", "dst")
    out = iterate.paths(_links(spark, d), pairs, 4)
    # Paths are short: each place is named by a join, and not each id of an array by a look-up.
    steps = _named(spark, d, out.select("src", "dst", "hops", F.posexplode("path").alias("at", "step")), "src", "dst", "step")
    path = F.transform(F.array_sort(F.collect_list(F.struct("at", "step"))), lambda x: x["step"])
    return steps.groupBy("src", "dst", "hops").agg(F.array_join(path, ">").alias("path"))


def label_propagation(spark, d):
    return _named(spark, d, iterate.communities(_links(spark, d), 3, once=True), "node", "community")


def community_hierarchy(spark, d):
    return _named(spark, d, iterate.hierarchy(_links(spark, d), 2, 3, once=True), "node", "community")


def contract_graph(spark, d):
    return _named(spark, d, iterate.contract(_links(spark, d), _member_ids(spark, d)), "src", "dst")


def modularity(spark, d):
    return graph.modularity(_links(spark, d), _member_ids(spark, d)).withColumn("modularity", F.round("modularity", 6))


def pagerank(spark, d):
    out = iterate.pagerank(cut(iterate.symmetric(base.purchase_edges(spark, d))), 5)
    return out.withColumn("rank", F.round("rank", 9))


def personalized_pagerank(spark, d):
    seeds = _seed_ids(spark, d).withColumn("w", F.lit(1.0))
    return iterate.ppr(_links(spark, d), seeds, 3, names=base.index(spark, d)["names"], both=True).withColumn("mass", F.round(F.col("mass") + 1e-13, 9))


def ppr_push(spark, d):
    """Masses by forward push; the settled state, not the number of rounds, is what the SQL repeats."""
    seeds = cut(_seed_ids(spark, d).withColumn("w", F.lit(1.0)))
    out = iterate.push_ppr(base.index(spark, d)["near"], seeds, 0.5, PPR_EPS)
    return _named(spark, d, out, "node").withColumn("mass", F.round(F.col("mass") + 1e-13, 9))


def triangle_count(spark, d):
    out = _named(spark, d, graph.triangles(_links(spark, d), both=True), "node")
    return out.withColumn("clustering", F.round("clustering", 6))


def neighbor_similarity(spark, d):
    out = _named(spark, d, graph.edge_similarity(_links(spark, d), both=True), "src", "dst")
    return out.withColumn("jaccard", F.round("jaccard", 6)).withColumn("adamic_adar", F.round("adamic_adar", 6))


def k_core(spark, d):
    return _named(spark, d, iterate.k_core(_links(spark, d), 10), "src", "dst")


def community_rollup(spark, d):
    e = _links(spark, d)
    levels = iterate.hierarchy(e, 2, 3, once=True)
    sub = levels.where("level = 0").select("node", F.col("community").alias("sub"))
    top = levels.where("level = 1").select("node", F.col("community").alias("top"))
    nodes = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))
    return _named(spark, d, graph.community_rollup(nodes, sub.join(top, "node")), "top", "sub")


def induced_subgraph(spark, d):
    e = _links(spark, d)
    start, asked = iterate.masks(_seed_ids(spark, d))
    reached = iterate.hop_masks(e, start, 1, both=True)
    near = cut(reached.groupBy("node", "block").agg(*[F.bit_or(c).alias(c) for c in iterate.mask_columns()]))
    # An edge is named once, before it is copied to its questions.
    named = _named(spark, d, graph.masked_subgraph(e, near), "src", "dst")
    return iterate.unmasked(named, asked).select("q_id", "src", "dst", "weight")


for _f in (
    degree_stats, triple_pattern, k_hop, connected_components, shortest_path, label_propagation,
    community_hierarchy, contract_graph, modularity, pagerank, personalized_pagerank, ppr_push, triangle_count,
    neighbor_similarity, k_core, community_rollup, induced_subgraph,
):
    QUERIES[_f.__name__] = _f

SQL["degree_stats"] = with_ctes("""
SELECT node, sum(o)::BIGINT AS n_out, sum(i)::BIGINT AS n_in, sum(o * w)::DOUBLE AS w_out, sum(i * w)::DOUBLE AS w_in
FROM (SELECT src AS node, 1 AS o, 0 AS i, weight AS w FROM buys UNION ALL SELECT dst, 0, 1, weight FROM buys) GROUP BY node""")
SQL["triple_pattern"] = """
WITH bought AS (SELECT DISTINCT c_nationkey AS n, c_custkey AS c, o_orderkey AS o, l_partkey AS p
  FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 1),
made AS (SELECT DISTINCT s_nationkey AS n, l_partkey AS p, s_suppkey AS s FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)
SELECT 'nation:' || n AS n, 'customer:' || c AS c, 'order:' || o AS o, 'part:' || p AS p, 'supplier:' || s AS s FROM bought JOIN made USING (n, p)"""
SQL["k_hop"] = with_ctes("SELECT q_id, node, hop::INTEGER AS hop FROM (SELECT * FROM hop0 UNION ALL SELECT * FROM hop1 UNION ALL SELECT * FROM hop2)")
SQL["connected_components"] = with_ctes(
    f"SELECT node, label AS component FROM {settled('lab', 14)}",
    "all_nodes AS MATERIALIZED (SELECT DISTINCT entity AS node FROM ments),\n" + min_labels("both_ways", "all_nodes", 14, "lab"),
)


def _bfs(rounds: int) -> str:
    parts = [
        "wanted AS MATERIALIZED (SELECT DISTINCT src, dst FROM (SELECT min(node) AS src, max(node) AS dst FROM qents GROUP BY q_id) WHERE src <> dst)",
        "r0 AS MATERIALIZED (SELECT DISTINCT src, src AS node, [src] AS path FROM wanted)",
    ]
    for i in range(1, rounds + 1):
        seen = " UNION ALL ".join(f"SELECT src, node FROM r{j}" for j in range(i))
        parts.append(
            f"r{i} AS MATERIALIZED (SELECT r.src, e.dst AS node, min(list_append(r.path, e.dst)) AS path "
            f"FROM r{i - 1} r JOIN both_ways e ON e.src = r.node ANTI JOIN ({seen}) s ON s.src = r.src AND s.node = e.dst GROUP BY ALL)"
        )
    every = " UNION ALL ".join(f"SELECT * FROM r{j}" for j in range(rounds + 1))
    parts.append(f"reached AS MATERIALIZED ({every})")
    return ",\n".join(parts)


SQL["shortest_path"] = with_ctes(
    "SELECT w.src, w.dst, (len(path) - 1)::INTEGER AS hops, array_to_string(path, '>') AS path "
    "FROM wanted w JOIN reached r ON r.src = w.src AND r.node = w.dst",
    _bfs(4),
)
SQL["label_propagation"] = with_ctes("SELECT node, community FROM member")
SQL["community_hierarchy"] = with_ctes("SELECT node, level, community FROM levels")
SQL["contract_graph"] = with_ctes("""
SELECT a.community AS src, b.community AS dst, sum(weight)::DOUBLE AS weight
FROM both_ways JOIN member a ON a.node = src JOIN member b ON b.node = dst GROUP BY ALL""")
SQL["modularity"] = with_ctes("""
SELECT round(sum(inside) / sum(total) - sum(total * total) / (sum(total) * sum(total)), 6) AS modularity, count(*) AS n_communities
FROM (SELECT a.community, sum(weight)::DOUBLE AS total,
             sum(CASE WHEN a.community = b.community THEN weight ELSE 0 END)::DOUBLE AS inside
      FROM both_ways JOIN member a ON a.node = src JOIN member b ON b.node = dst GROUP BY a.community)""")


def _rank_rounds(rounds: int) -> str:
    parts = [
        "ew AS MATERIALIZED (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS p FROM buys_both)",
        "pr0 AS MATERIALIZED (SELECT node, 1.0::DOUBLE / count(*) OVER () AS rank FROM (SELECT DISTINCT src AS node FROM buys_both))",
    ]
    for r in range(1, rounds + 1):
        parts.append(
            f"pr{r} AS MATERIALIZED (SELECT e.dst AS node, (1 - 0.85::DOUBLE) / (SELECT count(*) FROM pr0) + 0.85::DOUBLE * sum(s.rank * e.p) AS rank "
            f"FROM pr{r - 1} s JOIN ew e ON e.src = s.node GROUP BY e.dst)"
        )
    return ",\n".join(parts)


SQL["pagerank"] = with_ctes("SELECT node, round(rank, 9) AS rank FROM pr5", _rank_rounds(5))


def ppr_rounds(rounds: int, d: float) -> str:
    parts = [
        "es AS MATERIALIZED (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS p FROM both_ways)",
        "m0 AS MATERIALIZED (SELECT q_id, node, 1.0::DOUBLE / count(*) OVER (PARTITION BY q_id) AS mass FROM qents)",
    ]
    for r in range(1, rounds + 1):
        parts.append(
            f"m{r} AS MATERIALIZED (SELECT q_id, node, sum(mass) AS mass FROM ("
            f"SELECT s.q_id, e.dst AS node, {d}::DOUBLE * s.mass * e.p AS mass FROM m{r - 1} s JOIN es e ON e.src = s.node "
            f"UNION ALL SELECT q_id, node, (1 - {d}::DOUBLE) * mass FROM m0) GROUP BY ALL)"
        )
    return ",\n".join(parts)


def push_rounds(rounds: int, d: float, eps: float) -> str:
    """Rounds of forward push up to ``pushed``, an error if the last one leaves a residual over the bound."""
    due = f"r > 0 AND round(r, 12) >= round(t * {eps!r}::DOUBLE, 12)"
    parts = [
        "nw AS MATERIALIZED (SELECT src AS node, sum(weight)::DOUBLE AS t FROM both_ways GROUP BY src)",
        "ep AS MATERIALIZED (SELECT src, dst, weight / t AS p FROM both_ways JOIN nw ON node = src)",
        "p0 AS MATERIALIZED (SELECT q_id, node, 0.0::DOUBLE AS m, 1.0::DOUBLE / count(*) OVER (PARTITION BY q_id) AS r, coalesce(t, 0) AS t FROM qents LEFT JOIN nw USING (node))",
    ]
    for k in range(1, rounds + 1):
        parts.append(
            f"p{k} AS MATERIALIZED (SELECT q_id, node, sum(m) AS m, sum(r) AS r, coalesce(any_value(nw.t), 0) AS t FROM ("
            f"SELECT q_id, node, m + CASE WHEN {due} THEN (1 - {d}::DOUBLE) * r ELSE 0 END AS m, CASE WHEN {due} THEN 0 ELSE r END AS r FROM p{k - 1} "
            f"UNION ALL SELECT q_id, dst, 0, r * p * {d}::DOUBLE FROM p{k - 1} JOIN ep ON src = node WHERE {due}) LEFT JOIN nw USING (node) GROUP BY ALL)"
        )
    parts.append(
        f"pushed AS MATERIALIZED (SELECT q_id, node, CASE WHEN {due} THEN error('residuals not settled') ELSE m + (1 - {d}::DOUBLE) * r END AS mass FROM p{rounds})"
    )
    return ",\n".join(parts)


SQL["ppr_push"] = with_ctes("SELECT q_id, node, round(mass + 1e-13, 9) AS mass FROM pushed", push_rounds(12, 0.5, PPR_EPS))
SQL["personalized_pagerank"] = with_ctes("SELECT q_id, node, round(mass + 1e-13, 9) AS mass FROM m3", ppr_rounds(3, 0.85))
SQL["triangle_count"] = with_ctes("""
SELECT node, degree, coalesce(t, 0) AS n_triangles,
       round(CASE WHEN degree > 1 THEN 2.0::DOUBLE * coalesce(t, 0) / (degree * (degree - 1)) ELSE 0 END, 6) AS clustering
FROM (SELECT src AS node, count(*) AS degree FROM both_ways GROUP BY src)
LEFT JOIN (SELECT node, count(*) AS t FROM (
    SELECT unnest([a.src, a.dst, b.dst]) AS node FROM edges a JOIN edges b ON b.src = a.dst
    JOIN edges c ON c.src = a.src AND c.dst = b.dst) GROUP BY node) USING (node)""")
SQL["neighbor_similarity"] = with_ctes("""
SELECT src, dst, common, round(common / (ds + dd - common), 6) AS jaccard, round(aa, 6) AS adamic_adar FROM (
  SELECT e.src, e.dst, a.degree AS ds, b.degree AS dd, count(*) AS common, sum(1 / ln(w.degree)) AS aa
  FROM edges e JOIN both_ways x ON x.src = e.src JOIN both_ways y ON y.src = e.dst AND y.dst = x.dst
  JOIN deg a ON a.node = e.src JOIN deg b ON b.node = e.dst JOIN deg w ON w.node = x.dst GROUP BY ALL)""",
  "deg AS MATERIALIZED (SELECT src AS node, count(*) AS degree FROM both_ways GROUP BY src)")


def _core_rounds(k: int, rounds: int) -> str:
    parts = ["core0 AS MATERIALIZED (SELECT src, dst FROM both_ways)"]
    for r in range(1, rounds + 1):
        p = f"core{r - 1}"
        parts.append(
            f"keep{r} AS MATERIALIZED (SELECT src AS node FROM {p} GROUP BY src HAVING count(*) >= {k})"
        )
        parts.append(
            f"core{r} AS MATERIALIZED (SELECT src, dst FROM {p} WHERE src IN (SELECT node FROM keep{r}) AND dst IN (SELECT node FROM keep{r}))"
        )
    return ",\n".join(parts)


SQL["k_core"] = with_ctes("SELECT src, dst FROM core20", _core_rounds(10, 20))
SQL["community_rollup"] = with_ctes("""
SELECT t.community AS top, s.community AS sub, count(*) AS n_nodes, sum(degree)::BIGINT AS degree
FROM (SELECT src AS node, count(*) AS degree FROM both_ways GROUP BY src)
JOIN levels s USING (node) JOIN levels t USING (node) WHERE s.level = 0 AND t.level = 1
GROUP BY ROLLUP (t.community, s.community)""")
SQL["induced_subgraph"] = with_ctes("""
SELECT a.q_id, src, dst, weight::DOUBLE AS weight
FROM both_ways JOIN (SELECT q_id, node FROM hop0 UNION ALL SELECT q_id, node FROM hop1) a ON a.node = src
JOIN (SELECT q_id, node FROM hop0 UNION ALL SELECT q_id, node FROM hop1) b ON b.q_id = a.q_id AND b.node = dst""")
