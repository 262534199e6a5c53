"""Hard negatives against a brute-force version: every anchor against every row."""

import math
import random

import numpy as np
import pytest

from lodeweave.llm import hard_negatives as hn

COLS = "vec_id long, embedding array<float>, label int, anchor_id int, rank int, block int, v int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], COLS)


def brute(rows, step=100):
    kept = {}
    for vec_id, e, label in rows:
        if vec_id is None or label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        v = [math.floor(256 * float(np.float32(x))) for x in e]
        label = math.fmod(label + 1, 10) if vec_id % 7 == 0 else label
        kept[vec_id] = min(kept.get(vec_id, (int(label), v)), (int(label), v))
    out = set()
    for a, (la, va) in kept.items():
        if a % step:
            continue
        scored = [(-sum(x * y for x, y in zip(va, v)), b, lb) for b, (lb, v) in kept.items() if b != a and len(v) == len(va)]
        scored.sort()
        for s, p, _ in [x for x in scored if x[2] == la][:5]:
            ps = -s
            inside = [(-t, b) for t, b, lb in scored if lb != la and 80 * ps <= -100 * t <= 100 * ps][:5]
            out |= {(a, p, k + 1, b, ps, t) for k, (t, b) in enumerate(inside)}
    return out


def mined(spark, rows, **kw):
    got = [tuple(r) for r in hn.mine(frame(spark, rows), **kw).collect()]
    assert len(got) == len(set(got))
    return set(got)


def vectors(n, dims, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims))
    x[:, 0] += 2 * spread
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).tolist()


@pytest.mark.parametrize("dims", [2, 16])
def test_brute_force(spark, monkeypatch, dims):
    monkeypatch.setattr(hn, "BLOCK_ROWS", 150)
    monkeypatch.setattr(hn, "CHUNK_ANCHORS", 4)
    rows = [(k, v, k % 3) for k, v in enumerate(vectors(500, dims, dims))]
    assert mined(spark, rows, anchor_step=25) == brute(rows, 25)


def test_ties_and_signs(spark):
    """Few values, so many equal scores; anchors with negative and zero components."""
    r = random.Random(3)
    rows = [(k, [r.choice([-1.0, -0.5, 0.0, 0.5, 1.0]) for _ in range(4)], r.randrange(2)) for k in range(-200, 200)]
    assert mined(spark, rows, anchor_step=20) == brute(rows, 20)


def test_one_vector_common(spark):
    rows = [(k, [0.5, 0.25], k % 2) for k in range(300)] + [(k, [0.5, 0.3], 1) for k in range(300, 310)]
    assert mined(spark, rows) == brute(rows)


def test_odd_rows(spark):
    big = [3e38, 1.0]
    rows = [
        (0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (100, [1.0, 0.5], None), (200, None, 1), (300, [1.0, None], 1), (400, [1.0, math.inf], 1), (500, [math.nan, 1.0], 1), (None, [1.0, 0.5], 1),
        (600, [1.0], 1), (601, [1.0], 1), (602, [0.9], 2), (700, [], 3), (701, [], 3), (702, [], 4), (1, [0.9, 0.5], 1), (2, [0.85, 0.5], 2), (3, [0.9, 0.5], 2), (3, [0.9, 0.45], 2), (3, [0.9, 0.45], 5),
    ]
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, []) == set()
    got = mined(spark, rows + [(800, big, 1), (801, big, 1), (802, big, 2)])
    assert 802 in {r[3] for r in got if r[0] == 800 and r[1] == 801}


def test_stops_early():
    """On rows with a few far ahead the walk ends long before all are met."""
    n = 4000
    v = np.ones((n, 3), np.int64)
    v[:50] = 1000
    block = hn.Block(np.arange(n), np.zeros(n, np.int64), v, np.argsort(v, axis=0, kind="stable").astype(np.int32))
    looked = []
    real = block.walk
    block.walk = lambda a: (looked.append(len(x[0])) or x for x in real(a))
    ((ids, scores),) = hn.search(block, np.array([1, 1, 1]), np.ones(n, bool), [None])
    assert ids.tolist() == [0, 1, 2, 3, 4] and set(scores) == {3000}
    assert sum(looked) < 200
