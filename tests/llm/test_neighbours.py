import math
import random

import numpy as np

from lodeweave.llm import neighbours as nb


def brute(rows, every=50, k=5):
    ok = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        ok[i] = np.array(v, np.float64)
    out = {}
    for q, x in ok.items():
        if q % every == 0:
            s = [(-float(x @ y / (np.linalg.norm(x) * np.linalg.norm(y))), i) for i, y in ok.items() if i != q]
            out[q] = [(i, -c) for c, i in sorted(s)[:k]]
    return out


def answers(df, **more):
    got = {}
    for r in nb.search(df, **more).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: sorted(v) for q, v in got.items()}


def test_recall_and_scores(spark):
    for folder in ("sf0.01", "sf0.1"):
        df = spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet")
        want = brute([(r["vec_id"], r["embedding"]) for r in df.collect()])
        got = answers(df)
        assert set(got) == set(want)
        hit = sum(len({i for _, i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
        assert hit >= 0.9 * sum(map(len, want.values()))
        for q in want:
            assert [r for r, _, _ in got[q]] == list(range(1, len(want[q]) + 1))
            assert all(a[2] >= b[2] for a, b in zip(got[q], got[q][1:]))


def test_clusters_of_copies_and_odd_vectors(spark):
    rng = random.Random(3)
    rows = [(k, [rng.gauss(0, 1) for _ in range(8)]) for k in range(1000)]
    rows += [(k, [1.0] * 8) for k in range(1000, 1600)]
    rows += [(1650, None), (1700, [0.0] * 8), (1750, [float("nan")] + [1.0] * 7), (1800, [None] + [1.0] * 7), (1850, [float("inf")] * 8), (1200, [1.0] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, score string").repartition(4)
    got, want = answers(df), brute(rows)
    assert set(got) == set(want)
    for q in want:
        if q >= 1000:
            assert [i for _, i, _ in got[q]] == [i for i, _ in want[q]]
            assert all(abs(s - 1) < 1e-12 for _, _, s in got[q])


def test_small_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert answers(spark.createDataFrame([], schema)) == {}
    assert answers(spark.createDataFrame([(50, [1.0, 0.0])], schema)) == {}
    got = answers(spark.createDataFrame([(50, [1.0, 0.0]), (3, [1.0, 1.0]), (4, [2.0, 2.0])], schema))
    assert [i for _, i, _ in got[50]] == [3, 4]


def test_recall_holds_with_many_small_lists(spark):
    # As many lists, and as few vectors in each, as no fixed reach was chosen for.
    x = np.random.default_rng(5).standard_normal((6000, 32))
    df = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(4)
    vectors = nb.usable(df)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    asked = range(0, 6000, 20)
    scores = unit[::20] @ unit.T
    scores[np.arange(len(asked)), asked] = -2
    want = {(q, int(i)) for q, row in zip(asked, np.argsort(-scores, axis=1)[:, :5]) for i in row}

    def recall(reach):
        got = nb.nearest(vectors, vectors.where("vec_id % 20 = 0"), reach=reach, list_rows=10).collect()
        return len({(r["query_id"], r["vec_id"]) for r in got} & want) / len(want)

    assert recall(nb.REACH) < 0.9
    assert recall(None) >= 0.9
