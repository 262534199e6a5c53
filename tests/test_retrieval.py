import numpy as np
import pytest
from pyspark.sql import functions as F

import catalog
from catalog import base
from lodeweave.operators import agent, blocks, context, evaluate, graph, iterate, ordered, retrieve, vectors
from lodeweave.plans.build import Index
from lodeweave.session import cut, new_path
from lodeweave.sources import readers


@pytest.fixture(scope="module")
def vecs(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(200, 64)) + 3 * rng.normal(size=(5, 64))[rng.integers(0, 5, 200)]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, embedding array<double>")
    return m, df


def best(m, k):
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    return {q: [int(i) for i in sorted(range(len(m)), key=lambda i: (-s[q, i], i))[:k]] for q in range(len(m))}


def ids(hits):
    out = {}
    for r in hits.orderBy("q_id", "rank").collect():
        out.setdefault(r["q_id"], []).append(r["id"])
    return out


def test_exact_search_equals_brute_force(vecs):
    m, df = vecs
    q = df.select(F.col("id").alias("q_id"), "embedding")
    assert ids(vectors.knn(q, df, 4, n_lists=8)) == best(m, 4)
    assert ids(vectors.knn(q, df, 4, n_lists=8, rows_per_task=10)) == best(m, 4)


def test_inverted_lists(vecs):
    m, df = vecs
    q = df.select(F.col("id").alias("q_id"), "embedding")
    assert ids(vectors.ivf(q, df, 4, n_lists=6, n_probe=6)) == best(m, 4)
    exact = vectors.knn(q, df, 4)
    assert evaluate.ann_recall(vectors.ivf(q, df, 4, 6, 2), exact, 4).first()["recall"] > 0.7
    assert evaluate.ann_recall(vectors.lsh(q, df, 4), exact, 4).first()["recall"] > 0.5


def test_mmr_at_one_keeps_the_order(spark, vecs):
    _, df = vecs
    hits = spark.createDataFrame([(1, i, 1.0 / (i + 1), i + 1) for i in range(20)], "q_id long, id long, score double, rank int")
    assert ids(vectors.mmr(hits, df, 5, lam=1.0, id_col="id")) == {1: [0, 1, 2, 3, 4]}
    assert len(ids(vectors.mmr(hits, df, 5, lam=0.1, id_col="id"))[1]) == 5


def test_bm25_does_not_depend_on_salt(spark, sf):
    i = base.index(spark, sf)
    q = base.questions(spark, sf)
    a = retrieve.bm25(q, i["postings"], i["stats"], 5).collect()
    b = retrieve.bm25(q, i["postings"], i["stats"], 5, rarity=i["rarity"], rows_per_task=20).collect()
    assert sorted(a) == sorted(b) and a


def test_scores_are_added_up_where_the_chunks_are(spark, sf):
    i, q = base.index(spark, sf), base.questions(spark, sf)
    lists = (
        retrieve.bm25(q, i["postings"], i["stats"], 5, rarity=i["rarity"]),
        retrieve.tfidf(q, i["postings"], i["stats"], 5, i["rarity"], i["norms"]),
    )
    for hits in lists:
        plan = hits._jdf.queryExecution().executedPlan().toString()
        moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "chunk_id" in line.split("hashpartitioning", 1)[1]]
        assert not moved, plan


def test_trace_counts_what_is_new_and_a_run_replaces_itself(spark):
    first = spark.createDataFrame([(1, 1, "a", 2.0), (1, 1, "b", 1.0), (1, 2, "c", 3.0)], "q_id long, round int, chunk_id string, score double")
    second = spark.createDataFrame([(1, "b", 5.0), (1, "d", 4.0)], "q_id long, chunk_id string, score double")
    routes = spark.createDataFrame([(1, "text")], "q_id long, route string")
    out = agent.trace({"x": first, "y": second}, routes)
    want = {(1, 1, "x"): ("text", 2, 2.0, 2), (1, 1, "y"): ("text", 2, 5.0, 1), (1, 2, "x"): ("text", 1, 3.0, 1)}
    seen = lambda rows: {(r["q_id"], r["round"], r["step"]): (r["route"], r["n_hits"], r["best"], r["gain"]) for r in rows.collect()}
    assert seen(out) == want
    path = new_path(spark, "trace")
    for run in (1, 2, 2):
        log = agent.log_trace(out, path, run)
    assert log.count() == 6 and seen(log.where("run = 2")) == want


def test_fusing_one_list_keeps_it(spark, sf):
    hits = base.bm25_hits(spark, sf, 5)
    a = {(r["q_id"], r["rank"]): r["chunk_id"] for r in hits.collect()}
    assert {(r["q_id"], r["rank"]): r["chunk_id"] for r in retrieve.fuse([hits], 5).collect()} == a


def test_packing_never_passes_the_budget(spark, sf):
    used = context.pack(base.bm25_hits(spark, sf), base.chunks(spark, sf), 150).agg(F.max("used")).first()[0]
    assert used <= 150


def test_no_cartesian_product(spark, sf):
    for name in ("bm25_topk", "tfidf_cosine_topk", "vector_topk", "local_graph_search", "near_dedup", "triangle_count"):
        plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_answers_come_once_and_from_the_cache(spark):
    prompts = spark.createDataFrame([(1, "p"), (2, "p"), (3, "q")], "q_id long, prompt string")
    first = context.answer(prompts, lambda ps: [x.upper() for x in ps])
    assert {r["q_id"]: r["answer"] for r in first.collect()} == {1: "P", 2: "P", 3: "Q"}
    cache = first.where("q_id < 3").select("prompt_hash", "answer").distinct()

    def only_q(ps):
        assert ps == ["q"] or not ps
        return ["fresh"] * len(ps)

    got = {r["q_id"]: (r["answer"], r["cached"]) for r in context.answer(prompts, only_q, cache).collect()}
    assert got == {1: ("P", True), 2: ("P", True), 3: ("fresh", False)}


def test_as_of_across_blocks(spark):
    f = spark.createDataFrame([(1, 0, 7), (1, 100, 8), (2, 50, 9)], "k long, s long, v long")
    q = spark.createDataFrame([(1, 100, "a"), (1, 99, "b"), (1, 5000, "c"), (2, 10, "d"), (3, 1, "e")], "k long, s long, name string")
    at = lambda df: df.withColumn("ts", F.timestamp_seconds("s")).drop("s")
    out = ordered.as_of(at(q), at(f), "k", "ts", ["v"], block_seconds=60)
    assert {r["name"]: r["fact_v"] for r in out.collect()} == {"a": 8, "b": 7, "c": 8, "d": None, "e": None}


def test_running_sum_in_blocks(spark):
    df = spark.createDataFrame([(1, i) for i in range(50)], "k long, t long")
    out = ordered.running_sum(df, "k", "t", F.col("t"), "s", block=7)
    assert {r["t"]: r["s"] for r in out.collect()} == {i: i * (i + 1) // 2 for i in range(50)}
    back = ordered.running_sum(df, "k", "t", F.lit(1), "s", block=7, newest_first=True)
    assert {r["t"]: r["s"] for r in back.collect()} == {i: 50 - i for i in range(50)}


def test_memory_keeps_the_system_turn(spark):
    t = spark.createDataFrame([(1, 0, "system", "a b c"), (1, 1, "user", "d e"), (1, 2, "assistant", "f g h")], readers.TURNS)
    assert {r["turn"] for r in agent.memory(t, 3).collect()} == {0, 2}


def test_ask(spark, sf):
    from lodeweave.plans.ask import ask

    out = ask(base.questions(spark, sf), base.index(spark, sf), fn=context.first_passage)
    rows = out.collect()
    assert len(rows) == 40 and all(r["prompt"] for r in rows)


def test_each_route_runs_its_own_searches(spark, sf):
    from lodeweave.plans.ask import SEARCHES, retrieve_routed

    index, asked = base.index(spark, sf), base.questions(spark, sf)
    names = list(SEARCHES)
    routed = asked.select("q_id", F.element_at(F.array(*map(F.lit, names)), (F.col("q_id") % len(names) + 1).cast("int")).alias("route"))
    rows = retrieve_routed(asked, routed, index, 5).join(routed, "q_id").collect()
    assert {r["route"] for r in rows} == set(names)
    for r in rows:
        assert set(r["via"].split("+")) <= set(SEARCHES[r["route"]])


def test_buckets_do_not_grow_with_the_vectors():
    for n in (500, 5_000, 50_000, 5_000_000):
        assert vectors.BUCKET_ROWS / 2 <= n / 2 ** vectors.code_bits(n) <= vectors.BUCKET_ROWS
    assert vectors.code_bits(0) == vectors.code_bits(1) == 1


def test_pushed_masses_rank_like_exact_ones(spark, sf):
    """Ten best chunks by forward push against those by converged masses."""
    docs = readers.read_documents(spark, sf)
    index = Index(spark, docs)
    questions = index["chunks"].where("chunk_no = 0").select(F.col("doc_id").alias("q_id"), "text").limit(40)
    best = lambda hits: {(r["q_id"], r["chunk_id"]) for r in hits.collect()}
    exact = best(retrieve.ppr_search(questions, index["edges"], index["weights"], eps=None, rounds=8))
    pushed = best(retrieve.ppr_search(questions, index["edges"], index["weights"], eps=1e-5, graph=index["adjacency"]))
    assert len(exact & pushed) >= 0.95 * len(exact)


@pytest.mark.parametrize("n", [500, 2000])
@pytest.mark.parametrize("how", [vectors.ivf, vectors.lsh])
def test_measured_reach_finds_nine_of_ten(spark, how, n):
    """Vectors without clusters, the hardest case: the reach is measured, so recall does not fall with size."""
    m = np.random.default_rng(n).normal(size=(n, 64))
    v = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], "id long, embedding array<double>")
    q = v.where("id % 10 = 0").select(F.col("id").alias("q_id"), "embedding")
    want, got = best(m, 5), ids(how(q, v, 5))
    assert sum(len(set(want[x]) & set(got[x])) for x in got) >= 0.9 * 5 * len(got)
    assert len(got) == n // 10


def test_clusters_need_few_probes(spark, monkeypatch, vecs):
    m, v = vecs
    asked = []
    real = vectors.probe
    monkeypatch.setattr(vectors, "probe", lambda placed, probes, *a, **k: asked.append(probes.count()) or real(placed, probes, *a, **k))
    vectors.ivf(v.select(F.col("id").alias("q_id"), "embedding"), v, 5)
    assert asked[0] <= 200 * 15 / 2


def test_flip_order_is_by_margin():
    sets = vectors.flip_sets(4)
    assert len(sets) == 16 and not sets[0].any()
    order = vectors._probe_order(np.array([[0.9, -0.1, 0.5, 2.0]]), sets)[0]
    assert [int(sets[i] @ (1 << np.arange(4))) for i in order[:4]] == [0, 2, 4, 6]
    assert vectors.enough([1, 1, 2, 9]) == 9 and vectors.enough([1] * 95 + [7] * 5) == 1 and vectors.enough([]) == 1


def test_searches_on_few_rows(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 0.1])], "id long, embedding array<double>")
    q = v.select(F.col("id").alias("q_id"), "embedding")
    for how in (vectors.ivf, lambda *a: vectors.lsh(*a, dim=2)):
        assert {x[0] for x in ids(how(q.where("q_id = 1"), v, 1)).values()} == {1}
        assert how(q.limit(0), v, 1).count() == 0


def test_graph_search_reads_exact_masses(spark, sf):
    """The registered search takes three rounds over the whole graph, not pushed masses."""
    i = base.index(spark, sf)
    got = {tuple(r) for r in catalog.QUERIES["ppr_graph_search"](spark, sf).select("q_id", "chunk_id", "score", "rank").collect()}
    exact = retrieve.ppr_search(base.questions(spark, sf), i["edges"], i["weights"], eps=None)
    assert got == {tuple(r) for r in exact.select("q_id", "chunk_id", "score", "rank").collect()}
    assert "pushed" not in catalog.SQL["ppr_graph_search"]


def shuffled_rows(spark):
    gateway = spark.sparkContext._gateway
    store, none = spark._jsc.sc().statusStore(), gateway.jvm.java.util.ArrayList()
    stages = store.stageList(none, False, False, gateway.new_array(gateway.jvm.double, 0), none).iterator()
    total = 0
    while stages.hasNext():
        total += stages.next().shuffleWriteRecords()
    return total


@pytest.mark.parametrize("how", [vectors.knn, vectors.ivf, vectors.lsh])
def test_a_search_sends_blocks_and_not_pairs(spark, how):
    """A vector is sent once a block of questions, a question once a block of vectors, besides the best of each meeting."""
    n = 1200
    m = np.random.default_rng(5).normal(size=(n, 64))
    v = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], "id long, embedding array<double>")
    before = shuffled_rows(spark)
    assert how(v.select(F.col("id").alias("q_id"), "embedding"), v, 5).count() == 5 * n
    assert shuffled_rows(spark) - before < 60 * n


def test_marked_flips_are_the_first_of_their_order():
    sides = np.vstack((np.random.default_rng(2).normal(size=(40, 6)), np.zeros((1, 6))))
    sets = vectors.flip_sets(6)
    for n in (1, 7, 30, len(sets) + 1):
        order = vectors._probe_order(sides, sets)[:, :n]
        assert all(set(np.flatnonzero(row)) == set(o) for row, o in zip(vectors._nearest_sets(sides, sets, n), order))


def test_copies_are_ranked_by_id_across_blocks(spark):
    v = spark.createDataFrame([(i, [1.0, float(i % 2)]) for i in range(60)], "id long, embedding array<double>")
    q = v.where("id < 2").select(F.col("id").alias("q_id"), "embedding")
    got = ids(vectors.knn(q, v, 3, exclude_self=True, rows_per_task=7))
    assert got == {0: [2, 4, 6], 1: [3, 5, 7]}
    holes = v.union(spark.createDataFrame([(60, None), (61, [None, 1.0])], v.schema))
    assert ids(vectors.knn(q, holes, 3, exclude_self=True)) == got


@pytest.mark.parametrize("name", ["bm25", "tfidf"])
def test_scores_in_blocks_equal_joined_ones(spark, sf, name):
    """No pair of question and chunk is a row of the plan unless the weights of the batch are too many to hold."""
    i, q = base.index(spark, sf), base.questions(spark, sf)
    how = getattr(retrieve, name)
    more = {"norms": i["norms"]} if name == "tfidf" else {}
    blocks = how(q, i["postings"], i["stats"], 5, rarity=i["rarity"], **more)
    joined = how(q, i["postings"], i["stats"], 5, rarity=i["rarity"], cells=0, rows_per_task=20, **more)
    assert sorted(blocks.collect()) == sorted(joined.collect()) and not blocks.isEmpty()
    assert "q_id" not in blocks._jdf.queryExecution().analyzed().toString().split("MapInArrow")[-1].split("Aggregate", 1)[-1]


def test_buckets_grow_with_the_chunks(spark, sf, monkeypatch):
    from lodeweave.plans import build

    monkeypatch.setattr(build, "BUCKET_CHUNKS", 50)
    index = Index(spark, readers.read_documents(spark, sf))
    assert index.buckets == max(4, -(-index["chunks"].count() // 50)) > 4


def test_postings_count_the_terms_of_a_chunk(spark):
    few = spark.createDataFrame([("a", "b a b, c b"), ("e", "1 2"), ("z", "ä Ä x")], "chunk_id string, text string")
    got = {(r["chunk_id"], r["term"], r["tf"], r["dl"]) for r in retrieve.postings(few).collect()}
    assert got == {("a", "a", 1, 5), ("a", "b", 3, 5), ("a", "c", 1, 5), ("z", "ä", 2, 3), ("z", "x", 1, 3)}


def test_ppr_moves_arrays_and_not_a_row_a_question_and_link(spark):
    """300 questions, two blocks, over a graph of all pairs: what is shuffled does not grow with questions times nodes."""
    n, asked, d = 100, 300, 0.5
    edges = spark.createDataFrame([(a, b, float((a * b) % 7 + 1)) for a in range(n) for b in range(n) if a != b], "src int, dst int, weight double").localCheckpoint()
    seeds = spark.createDataFrame([(q, x % n, 1.0) for q in range(asked) for x in (q, 3 * q + 1)], "q_id long, node int, w double").localCheckpoint()
    before = shuffled_rows(spark)
    mass = cut(iterate.ppr(edges, seeds, 3, d))
    assert shuffled_rows(spark) - before < asked * n
    start, step = np.zeros((asked, n)), np.array([[(a * b) % 7 + 1.0 if a != b else 0.0 for b in range(n)] for a in range(n)])
    for q in range(asked):
        for x in (q, 3 * q + 1):
            start[q, x % n] += 0.5
    step, want = step / step.sum(axis=1, keepdims=True), start
    for _ in range(3):
        want = d * want @ step + (1 - d) * start
    got = np.zeros((asked, n))
    for r in mass.collect():
        got[r["q_id"], r["node"]] = r["mass"]
    assert np.allclose(got, want, atol=1e-12)


def test_mentions_are_scored_in_blocks(spark):
    """300 questions whose masses lie on all nodes, and chunks with equal scores; no row a question and chunk is shuffled."""
    rng, n, asked, k = np.random.default_rng(5), 60, 300, 4
    held = {f"{c:03d}": sorted(rng.choice(n, 5, replace=False).tolist()) for c in range(0, 400, 2)}
    held |= {f"{int(c) + 1:03d}": v for c, v in list(held.items())[:50]}
    mentions = spark.createDataFrame([(x, c, 1.0 + x % 3) for c, v in held.items() for x in v], "node int, chunk_id string, weight double").localCheckpoint()
    values = np.round(rng.random((asked, n)), 2)
    rows = spark.createDataFrame([(q, x, float(values[q, x])) for q in range(asked) for x in range(n)], "q_id long, node int, mass double")
    questions = iterate.batch(rows)
    state = cut(blocks.dense(rows, questions))
    before = shuffled_rows(spark)
    got = retrieve.top_k(blocks.best_chunks(state, questions, mentions, k, 300), k, "x").collect()
    assert shuffled_rows(spark) - before < asked * len(held)
    for q in range(0, asked, 37):
        score = {c: round(sum(values[q, x] * (1.0 + x % 3) for x in v), 6) for c, v in held.items()}
        want = sorted(score, key=lambda c: (-score[c], c))[:k]
        assert [r["chunk_id"] for r in sorted((r for r in got if r["q_id"] == q), key=lambda r: r["rank"])] == want


def test_similar_neighbours_shuffle_no_row_an_edge_and_neighbour(spark, monkeypatch):
    """all pairs of 60 nodes, 1,770 edges with 58 common neighbours each."""
    links = spark.createDataFrame([(a, b, 2) for a in range(60) for b in range(60) if a != b], "src int, dst int, weight long").localCheckpoint()
    monkeypatch.setattr(base, "index", lambda *_: {"links": links, "names": spark.createDataFrame([(f"n{a:02d}", a) for a in range(60)], "entity string, id int")})
    before = shuffled_rows(spark)
    rows = cut(catalog.QUERIES["neighbor_similarity"](spark, "")).collect()
    assert shuffled_rows(spark) - before < 10 * 1770
    assert len(rows) == 1770 and {r["common"] for r in rows} == {58} and rows[0]["src"] < rows[0]["dst"]


def test_push_reads_links_by_ids(spark, sf, monkeypatch):
    """forward push takes its lists from the links; edges by name, two joins of all links, are not built for it."""
    built = Index(spark, readers.read_documents(spark, sf))
    monkeypatch.setattr(base, "index", lambda *_: built)
    assert catalog.QUERIES["ppr_push"](spark, sf).count()
    assert not {"edges", "adjacency"} & set(built._built)


def test_pattern_copies_no_binding_that_a_later_one_drops(spark):
    """400 orders of one part with 100 suppliers, of which one sits in the customer's nation; 40,000 rows would meet the last pattern."""
    facts = [("n:0", "in_region", "r:1"), ("c:0", "in_nation", "n:0"), ("s:0", "in_nation", "n:0")] + [(f"s:{s}", "in_nation", "n:9") for s in range(1, 100)]
    facts += [(f"o:{o}", "placed_by", "c:0") for o in range(400)] + [(f"o:{o}", "has_part", "p:0") for o in range(400)] + [("p:0", "by", f"s:{s}") for s in range(100)]
    triples = spark.createDataFrame(facts, "src string, rel string, dst string").localCheckpoint()
    asked = [("?n", "in_region", "r:1"), ("?c", "in_nation", "?n"), ("?o", "placed_by", "?c"), ("?o", "has_part", "?p"), ("?p", "by", "?s"), ("?s", "in_nation", "?n")]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled_rows(spark)
        rows = cut(graph.match(triples, asked)).collect()
        assert shuffled_rows(spark) - before < 10_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(rows) == 400 and {(r["n"], r["c"], r["p"], r["s"]) for r in rows} == {("n:0", "c:0", "p:0", "s:0")}
    doubled = graph.match(triples.union(triples), asked)
    assert sorted(map(tuple, doubled.select("o", "s").collect())) == sorted((r["o"], r["s"]) for r in rows)


def test_hash_embed_takes_postings_and_its_tasks_grow_with_the_rows(spark):
    words = ["apple", "pear", "plum", "fig"]
    texts = spark.createDataFrame([(f"{i}:0", " ".join(words[: 1 + i % 4] * (1 + i % 3))) for i in range(40)], "chunk_id string, text string")
    post = retrieve.postings(texts)
    rarity = post.groupBy("term").agg(F.count("*").alias("df"))
    few, many = (retrieve.hash_embed(texts, rarity, F.lit(40), rows_per_task=n) for n in (10**6, 64))
    got = {r["chunk_id"]: [round(x, 9) for x in r["embedding"]] for r in many.collect()}
    assert len(got) == 40 and got == {r["chunk_id"]: [round(x, 9) for x in r["embedding"]] for r in few.collect()}
    assert got == {r["chunk_id"]: [round(x, 9) for x in r["embedding"]] for r in retrieve.hash_embed(post, rarity, F.lit(40)).collect()}
    # A row has at most 64 sums, so 64 of them are one row a task.
    assert many.rdd.getNumPartitions() == 40 and few.rdd.getNumPartitions() == 4


def test_postings_of_null_and_empty_texts(spark):
    rows = spark.createDataFrame([(1, "B a b"), (2, None), (3, "1 2"), (4, "ä")], "doc_id bigint, text string")
    got = sorted(tuple(r) for r in retrieve.postings(rows, "doc_id").collect())
    assert got == [("a", 1, 1, 3), ("b", 1, 2, 3), ("ä", 4, 1, 1)]
