"""Links, mentions and postings are read where they lie: what is shuffled grows with the nodes, chunks or packs. Spark may not send small tables by itself here."""

import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeweave.operators import context, corpus, graph, graph_build, iterate, packs, retrieve
from lodeweave.session import cut, new_path
from lodeweave.sources.index import write_bucketed
from tests.test_retrieval import shuffled_rows

N = 120


@pytest.fixture(autouse=True)
def no_small_tables(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def stored(spark, df, key):
    name = f"t_{uuid.uuid4().hex}"
    return write_bucketed(df.repartition(4, key), name, [key], 4, new_path(spark, name))


@pytest.fixture(scope="module")
def links(spark):
    """All pairs of 120 nodes, 14,280 links."""
    rows = [(a, b, float((a * b) % 7 + 1)) for a in range(N) for b in range(N) if a != b]
    return stored(spark, spark.createDataFrame(rows, "src int, dst int, weight double"), "src")


@pytest.fixture(scope="module")
def seeds(spark):
    return cut(spark.createDataFrame([(q, q % N, 1.0) for q in range(70)], "q_id long, node int, w double"))


@pytest.mark.parametrize(
    "name, run",
    [
        ("F13 label_propagation", lambda e, s: iterate.communities(e, 2)),
        ("F17 community_hierarchy", lambda e, s: iterate.hierarchy(e)),
        ("F12 modularity", lambda e, s: graph.modularity(e, cut(iterate.communities(e, 1)))),
        ("F11 community_rollup", lambda e, s: iterate.contract(e, cut(iterate.communities(e, 1)))),
        ("F15 k_hop", lambda e, s: iterate.hop_masks(e, iterate.masks(s)[0], 2, both=True)),
        ("F6 induced_subgraph", lambda e, s: graph.masked_subgraph(e, cut(iterate.masks(s.select(F.col("q_id") % 5, "node").toDF("q_id", "node"))[0]))),
        ("F20 shortest_path", lambda e, s: iterate.paths(e, s.where("q_id < 9").select(F.lit(0).alias("src"), F.col("node").alias("dst")), 3)),
        ("F7 connected_components", lambda e, s: iterate.components_of_links(e, e.select(F.col("src").alias("node")).distinct())),
        ("F18 ppr_push", lambda e, s: iterate.adjacency(e)),
        ("F1 personalized_pagerank, F2 F3 ppr_graph_search", lambda e, s: iterate.ppr(e, s, 2, both=True)),
        ("F4 triangle_count", lambda e, s: graph.triangles(e, both=True)),
        ("F5 neighbor_similarity", lambda e, s: graph.edge_similarity(e, both=True)),
    ],
)
def test_links_stay_where_they_lie(spark, links, seeds, name, run):
    before = shuffled_rows(spark)
    assert cut(run(links, seeds)).count()
    assert shuffled_rows(spark) - before < links.count() / 3


def test_packs(spark):
    r = np.random.default_rng(1)
    for values in (np.zeros(0, np.int64), np.array([0, 255, 256, 2**40]), r.integers(0, 10**9, 500)):
        assert packs.unpacked(packs.packed(values)).tolist() == values.tolist()
        keys, n = packs.counted(np.concatenate((values, values[:3])))
        assert packs.unpacked_keys(packs.packed_keys(keys)).tolist() == sorted(set(values.tolist())) and n.sum() == len(values) + len(values[:3])
    ids = r.integers(0, 2**31 - 1, 300).astype(np.int32)
    df = spark.createDataFrame([(int(i),) for i in ids], "id int").select("id", F.expr("pmod(hash(id), 13)").alias("b"))
    assert {x["id"]: x["b"] for x in df.collect()} == dict(zip(ids.tolist(), packs.bucket(ids, 13).tolist()))


@pytest.mark.parametrize("pairs", [10**6, 40])
def test_links_travel_as_packs(spark, monkeypatch, pairs):
    """F13 and all that read the links: no pair is a row of a shuffle, both directions lie by source, and chunks go on over batches."""
    monkeypatch.setattr(graph_build, "PAIRS", pairs)
    r = random.Random(3)
    chunks = {f"{c:03d}": sorted(r.sample(range(30), 12)) for c in range(150)}
    rows = [(f"e{e:02d}", c, 1) for c, es in chunks.items() for e in es]
    m = spark.createDataFrame(rows, "entity string, chunk_id string, n long").coalesce(2)
    ids, df = cut(iterate.numbered(m)), cut(m.groupBy("entity").agg(F.count("*").alias("df")))
    want = {}
    for es in chunks.values():
        for a in es:
            for b in es:
                if a != b:
                    want[a, b] = want.get((a, b), 0) + 1
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        lists = cut(graph_build.entity_lists(m, ids, df))
        assert sorted(sorted(x["es"]) for x in lists.collect()) == sorted(chunks.values())
        before = shuffled_rows(spark)
        found, parts = graph_build.id_links(lists, ids, 40)
        got = found.withColumn("part", F.spark_partition_id()).collect()
        if pairs > 40:
            assert shuffled_rows(spark) - before < 150 * 66 / 10
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(x["src"], x["dst"]): x["weight"] for x in got} == {k: n for k, n in want.items() if n >= 40}
    assert len({(x["src"], x["part"]) for x in got}) == len({x["src"] for x in got})


def random_links(spark, n, m, seed):
    r = random.Random(seed)
    pairs = {tuple(sorted(r.sample(range(n), 2))) for _ in range(m)}
    return pairs, cut(spark.createDataFrame([x for a, b in pairs for x in ((a, b, 1.0), (b, a, 1.0))], "src int, dst int, weight double"))


@pytest.mark.parametrize("m", [20, 45, 90])
def test_components_and_paths_of_random_links(spark, m):
    """components equal those of ``components``; paths are the least of the shortest, up to the longest asked for."""
    pairs, e = random_links(spark, 60, m, m)
    nodes = spark.createDataFrame([(i,) for i in range(60)], "node int")
    got = {tuple(r) for r in iterate.components_of_links(e, nodes).collect()}
    assert got == {tuple(r) for r in iterate.components(e, nodes).collect()} and len(got) == 60
    near = {a: sorted({y for x in pairs for y in x if a in x and y != a}) for a in range(60)}
    want = {}
    for src in (0, 1, 2):
        paths = {src: [src]}
        frontier = dict(paths)
        for _ in range(4):
            new = {}
            for node, path in frontier.items():
                for y in near[node]:
                    if y not in paths:
                        new[y] = min(new.get(y, [99]), path + [y])
            paths |= new
            frontier = new
        want |= {(src, dst): path for dst, path in paths.items()}
    asked = spark.createDataFrame([(s, t) for s in (0, 1, 2) for t in range(60)], "src int, dst int")
    assert {(r["src"], r["dst"]): r["path"] for r in iterate.paths(e, asked, 4).collect()} == want


def test_local_search_moves_no_mention(spark, links):
    """F8 local_graph_search, F9 step_trace: mentions meet the neighbourhoods where they lie, for 260 questions in blocks."""
    names = [f"e{a:03d}" for a in range(N)]
    ids = cut(spark.createDataFrame(list(zip(names, range(N))), "entity string, id int"))
    r = random.Random(5)
    rows = [(names[x], f"c{c:04d}", 1.0 + x % 5) for c in range(800) for x in r.sample(range(N), 10)]
    mentions = stored(spark, spark.createDataFrame(rows, "entity string, chunk_id string, weight double"), "chunk_id")
    few = stored(spark, links.where("abs(src - dst) < 3"), "src")
    asked = spark.createDataFrame([(q, names[q % N]) for q in range(260)], "q_id long, term string")
    before = shuffled_rows(spark)
    got = {}
    for x in cut(retrieve.local_search(asked, few, mentions, 3, ids=ids)).orderBy("q_id", "rank").collect():
        got.setdefault(x["q_id"], []).append((x["chunk_id"], x["score"]))
    assert shuffled_rows(spark) - before < 260 * 80
    for q in (0, 7, 63, 64, 119, 255):
        score = {}
        for e, c, w in rows:
            far = abs(int(e[1:]) - q % N)
            if far < 3:
                score[c] = score.get(c, 0) + w / (1 + (far > 0))
        assert got[q] == sorted(((c, round(s, 6)) for c, s in score.items()), key=lambda x: (-x[1], x[0]))[:3]


def test_norms_are_summed_where_postings_lie(spark):
    """F16 rrf_fuse, F19 tfidf_cosine_topk: with all terms held no posting is shuffled; with few held only those of the others are."""
    r = random.Random(2)
    rows = [(f"t{t}", f"c{c}", 1 + (t + c) % 3) for c in range(200) for t in {*r.sample(range(30), 15), 100 + c // 2}]
    post = stored(spark, spark.createDataFrame(rows, "term string, chunk_id string, tf long"), "chunk_id")
    rarity = cut(post.groupBy("term").agg(F.count("*").alias("df")))
    stats = cut(spark.createDataFrame([(200, 15.0)], "n long, avgdl double"))
    df = {x["term"]: x["df"] for x in rarity.collect()}
    want = {}
    for t, c, tf in rows:
        want[c] = want.get(c, 0) + ((1 + np.log(tf)) * np.log(1 + 200 / df[t])) ** 2
    for terms, most in ((1000, 200), (40, 1600)):
        before = shuffled_rows(spark)
        got = {x["chunk_id"]: x["norm"] for x in cut(retrieve.chunk_norms(post, stats, rarity, terms)).collect()}
        assert shuffled_rows(spark) - before <= most < len(rows)
        assert got == pytest.approx({c: s**0.5 for c, s in want.items()})


@pytest.mark.parametrize("at_a_time", [10**6, 50])
def test_community_terms_are_counted_in_the_chunks(spark, monkeypatch, at_a_time):
    """F10 global_graph_search, F14 community_reports: neither postings nor mentions are shuffled by chunk."""
    monkeypatch.setattr(context, "TERMS", at_a_time)
    r = random.Random(4)
    texts = {f"c{c:03d}": [f"w{chr(97 + r.randrange(20))}" for _ in range(40)] for c in range(200)}
    chunks = spark.createDataFrame([(c, " ".join(t)) for c, t in texts.items()] + [("none", "q q")], "chunk_id string, text string").coalesce(2)
    of = {f"w{chr(97 + x)}": f"w{chr(97 + x % 3)}" for x in range(6)}
    members = cut(spark.createDataFrame(list(of.items()), "node string, community string"))
    mentions = spark.createDataFrame([(e, c, 1) for c, t in texts.items() for e in set(t) & set(of)], "entity string, chunk_id string, n long")
    want = {}
    for t in texts.values():
        for community in {of[x] for x in t if x in of}:
            for x in t:
                want[community, x] = want.get((community, x), 0) + 1
    before = shuffled_rows(spark)
    got = {(x["community"], x["term"]): x["n"] for x in cut(context.community_terms(members, mentions, chunks)).collect()}
    assert got == want
    if at_a_time > 50:
        assert shuffled_rows(spark) - before < 1000


def test_weights_and_entities_stay_by_chunk(spark):
    """The mentions that the graph searches read are found and weighed without a shuffle of postings, and each text is read in its place."""
    rows = [(f"term{t}", f"c{c}", 1, 9) for c in range(300) for t in range(c % 7, 20)]
    post = stored(spark, spark.createDataFrame(rows, "term string, chunk_id string, tf long, dl int"), "chunk_id")
    band = cut(spark.createDataFrame([(f"term{t}", 9) for t in range(15)], "entity string, df long"))
    chunks = spark.range(300)
    before = shuffled_rows(spark)
    mentions = stored_mentions = graph_build.entities_in(post, band)
    assert cut(mentions).count() == sum(t < 15 for c in range(300) for t in range(c % 7, 20))
    assert cut(graph_build.mention_edges(stored_mentions, chunks)).count() == mentions.count()
    assert shuffled_rows(spark) - before < 500


def test_dedup_shuffles_no_text(spark):
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    docs = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (4, None), (5, None), (None, "c"), (6, "d")], "doc_id long, text string").repartition(3).localCheckpoint()
    out = corpus.dedup(docs)
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 2, 4, 6]
    assert "Exchange hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
