import random

import pytest
from pyspark.sql import functions as F

from catalog import base
from lodeweave.operators import graph, graph_build, iterate
from lodeweave.session import cut

CLIQUES = [(a, b) for g in ("abcd", "efgh") for i, a in enumerate(g) for b in g[i + 1 :]] + [("d", "e")]


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def as_dict(df):
    return {r[0]: r[1] for r in df.collect()}


def test_components(spark):
    e = edges(spark, [("a", "b"), ("c", "d"), ("d", "x"), ("x", "y"), ("q", "q")])
    nodes = spark.createDataFrame([("lone",)], "node string")
    assert as_dict(iterate.components(e, nodes)) == dict(
        a="a", b="a", c="c", d="c", x="c", y="c", q="q", lone="lone"
    )


def test_components_of_long_path(spark):
    n = 40
    e = spark.createDataFrame([(i, i + 1) for i in range(n)], "src long, dst long")
    assert set(as_dict(iterate.components(e)).values()) == {0}


def test_k_hop_and_path(spark):
    e = iterate.symmetric(edges(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("a", "x"), ("x", "c")]))
    seeds = spark.createDataFrame([(1, "a")], "q_id long, node string")
    hops = {r["node"]: r["hop"] for r in iterate.k_hop(e, seeds, 3).collect()}
    assert hops == {"a": 0, "b": 1, "x": 1, "c": 2, "d": 3}
    pairs = edges(spark, [("a", "d"), ("b", "x"), ("a", "nowhere")])
    got = {(r["src"], r["dst"]): (r["hops"], r["path"]) for r in iterate.paths(e, pairs, 5).collect()}
    assert got == {("a", "d"): (3, ["a", "b", "c", "d"]), ("b", "x"): (2, ["b", "a", "x"])}


def test_triangles(spark):
    rows = {r["node"]: r for r in graph.triangles(edges(spark, CLIQUES + [("a", "a")])).collect()}
    assert sum(r["n_triangles"] for r in rows.values()) == 8 * 3
    assert rows["a"]["clustering"] == 1.0 and rows["d"]["n_triangles"] == 3
    star = graph.triangles(edges(spark, [("h", f"x{i}") for i in range(5)]))
    assert star.agg({"n_triangles": "sum"}).first()[0] == 0


def test_communities_and_modularity(spark):
    both = iterate.symmetric(edges(spark, CLIQUES))
    found = iterate.communities(both, 4)
    groups = as_dict(found)
    assert len({groups[x] for x in "abc"}) == 1 and len({groups[x] for x in "fgh"}) == 1
    whole = found.select("node").selectExpr("node", "'one' AS community")
    assert graph.modularity(both, whole).first()["modularity"] == pytest.approx(0.0)


def test_pagerank_sums_to_one_and_does_not_depend_on_salt(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("c", "sink")])
    plain = as_dict(iterate.pagerank(e, 6))
    salted = as_dict(iterate.pagerank(e, 6, rows_per_task=1))
    assert sum(plain.values()) == pytest.approx(1.0)
    assert salted == pytest.approx(plain)
    cycle = as_dict(iterate.pagerank(edges(spark, [("a", "b"), ("b", "c"), ("c", "a")]), 5))
    assert all(v == pytest.approx(1 / 3) for v in cycle.values())


def test_ppr_keeps_its_mass(spark):
    both = iterate.symmetric(edges(spark, CLIQUES))
    seeds = spark.createDataFrame([(1, "a", 1.0), (2, "h", 3.0), (2, "g", 1.0)], "q_id long, node string, w double")
    for rows in (10**6, 2):
        mass = iterate.ppr(both, seeds, 4, rows_per_task=rows).groupBy("q_id").sum("mass")
        assert all(v == pytest.approx(1.0) for v in as_dict(mass).values())


def test_k_core(spark):
    both = iterate.symmetric(edges(spark, CLIQUES + [("a", "tail"), ("tail", "end")]))
    left = {r["src"] for r in iterate.k_core(both, 3).collect()}
    assert left == set("abcdefgh")
    path = [(f"n{k:03d}", f"n{k + 1:03d}") for k in range(30)]
    assert iterate.k_core(iterate.symmetric(edges(spark, path)), 2).count() == 0


def test_match_needs_a_shared_variable(spark):
    t = spark.createDataFrame([("a", "r", "b"), ("b", "s", "c")], "src string, rel string, dst string")
    assert [tuple(r) for r in graph.match(t, [("?x", "r", "?y"), ("?y", "s", "?z")]).select("x", "y", "z").collect()] == [("a", "b", "c")]
    with pytest.raises(ValueError):
        graph.match(t, [("?x", "r", "?y"), ("?u", "s", "?v")])


def _random_graph(spark, n, m, seed):
    r = random.Random(seed)
    pairs = {tuple(sorted(r.sample(range(n), 2))) for _ in range(m)} | {(0, k) for k in range(1, n)}
    rows = [(f"n{a}", f"n{b}", r.randint(1, 9)) for a, b in sorted(pairs)]
    return cut(iterate.symmetric(spark.createDataFrame(rows, "src string, dst string, weight long")))


@pytest.mark.parametrize("eps", [1e-3])
def test_push_stays_within_its_bound(spark, monkeypatch, eps):
    """Never over the converged masses, and under them by eps times the weight of the node at most; a hub has several lists."""
    monkeypatch.setattr(iterate, "LIST", 16)
    edges = _random_graph(spark, 60, 150, 1)
    seeds = spark.createDataFrame([(1, "n5", 1.0), (1, "n9", 3.0), (2, "n0", 1.0), (3, "lone", 2.0)], "q_id long, node string, w double")
    graph = cut(iterate.adjacency(edges))
    assert graph.where("src = 'n0'").count() > 1
    weight = {r["node"]: r["w"] for r in edges.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("w")).collect()}
    exact = {(r["q_id"], r["node"]): r["mass"] for r in iterate.ppr(edges, seeds, 20, 0.5).collect()}
    got = {(r["q_id"], r["node"]): r["mass"] for r in iterate.push_ppr(graph, seeds, 0.5, eps).collect()}
    assert got.pop((3, "lone")) == exact.pop((3, "lone")) == 0.5
    for key, mass in exact.items():
        assert -1e-5 <= mass - got.get(key, 0.0) <= eps * weight[key[1]] + 1e-5
    assert set(got) <= set(exact)
    assert iterate.push_ppr(graph, seeds.limit(0), 0.5, eps).count() == 0


def test_push_reads_only_the_surroundings(spark):
    """On a long path with a loose bound the far end is never reached."""
    rows = [(f"p{k:04d}", f"p{k + 1:04d}", 1) for k in range(2000)]
    graph = cut(iterate.adjacency(iterate.symmetric(spark.createDataFrame(rows, "src string, dst string, weight long"))))
    seeds = spark.createDataFrame([(1, "p0000", 1.0)], "q_id long, node string, w double")
    assert iterate.push_ppr(graph, seeds, 0.5, 1e-3).count() < 40


@pytest.mark.parametrize("edges_per_task", [10**6, 400, 60])
def test_triangles_by_colours(spark, edges_per_task):
    """Any number of colours counts each triangle once; a hub meets all nodes, edges are repeated and go both ways."""
    r = random.Random(4)
    pairs = {tuple(sorted(r.sample(range(40), 2))) for _ in range(200)} | {(0, k) for k in range(1, 40)}
    near = {k: {b if a == k else a for a, b in pairs if k in (a, b)} for k in range(40)}
    rows = [(f"n{a}", f"n{b}") for a, b in pairs] + [(f"n{b}", f"n{a}") for a, b in list(pairs)[:50]] + [("n1", "n1")]
    got = {r["node"]: (r["degree"], r["n_triangles"]) for r in graph.triangles(edges(spark, rows), edges_per_task).collect()}
    assert got == {f"n{k}": (len(near[k]), sum(len(near[k] & near[j]) for j in near[k]) // 2) for k in near}
    assert graph.triangles(edges(spark, rows).limit(0), edges_per_task).count() == 0


def test_pairs_are_counted_from_lists_of_ids(spark):
    """Ids follow the names, and counts go on over the batches of a frequent entity."""
    r = random.Random(7)
    rows = [(f"e{e:02d}", str(c), 1) for c in range(120) for e in {0, *r.sample(range(30), 6)}]
    m = spark.createDataFrame(rows, "entity string, chunk_id string, n long")
    ids = cut(graph_build.numbered(m))
    assert [x["entity"] for x in ids.orderBy("id").collect()] == sorted({x[0] for x in rows})
    held = {}
    for e, c, _ in rows:
        held.setdefault(c, set()).add(e)
    want = {}
    for es in held.values():
        for a in es:
            for b in es:
                if a < b:
                    want[a, b] = want.get((a, b), 0) + 1
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        got = {(x["src"], x["dst"]): x["weight"] for x in graph_build.cooccur(m, 3, ids).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {k: n for k, n in want.items() if n >= 3}
    assert graph_build.cooccur(m.limit(0)).count() == 0


def test_votes_are_summed_where_the_links_lie(spark, sf, monkeypatch):
    """No round of label propagation over the index's links shuffles them."""
    plans, links = [], base.index(spark, sf)["links"]

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(iterate, "cut", noted)
    iterate.communities(links, 2)
    rounds = [p for p in plans if "community" in p and "hashpartitioning(src" not in p and "hashpartitioning(dst" not in p]
    assert len(rounds) == len(plans) == 3


def test_questions_walk_as_bits_of_a_mask(spark, monkeypatch):
    """More questions than a mask has bits; no round holds a row for each question and node."""
    n, r = 150, random.Random(9)
    e = _random_graph(spark, 40, 60, 2)
    seeds = [(q * 3 - 200, f"n{r.randrange(1, 40)}") for q in range(n) for _ in range(2)]
    near = {}
    for row in e.collect():
        near.setdefault(row["src"], set()).add(row["dst"])
    want = {}
    for q, node in seeds:
        want[q, node] = 0
    for hop in (1, 2):
        for (q, node), h in list(want.items()):
            if h == hop - 1:
                for x in near[node]:
                    want.setdefault((q, x), hop)
    rows = []

    def noted(df):
        out = cut(df)
        rows.append((out.columns, out.count()))
        return out

    monkeypatch.setattr(iterate, "cut", noted)
    df = spark.createDataFrame(seeds, "q_id long, node string")
    found = iterate.k_hop(e, df, 2)
    assert {(x["q_id"], x["node"]): x["hop"] for x in found.collect()} == want
    assert all(count <= 40 * 3 for columns, count in rows if "node" in columns)
    inside = iterate.k_hop(e, df, 1)
    held = {(x["q_id"], x["node"]) for x in inside.collect()}
    got = sorted((x["q_id"], x["src"], x["dst"]) for x in graph.subgraph(e, inside).collect())
    assert got == sorted((q, a, b) for q, a in held for b in near[a] if (q, b) in held)


@pytest.mark.parametrize("held", [10**6, 300, 40])
def test_edges_are_compared_in_triples_of_colours(spark, monkeypatch, held):
    """the similarity of all edges equals that of ``common_neighbors``, with any number of colours and steps."""
    monkeypatch.setattr(graph, "WEDGES", 7)
    e = _random_graph(spark, 40, 260, 4).select("src", "dst").where("src < dst")
    every = lambda df: {(r["src"], r["dst"]): (r["common"], round(r["jaccard"], 9), round(r["adamic_adar"], 9)) for r in df.collect()}
    want, got = every(graph.common_neighbors(e, e)), every(graph.edge_similarity(e.union(e.selectExpr("dst", "src")), held))
    assert got == want and len(want) > 100
