import random

import numpy as np
import xxhash

from lodeweave.llm import simhash
from lodeweave.llm.common import table


def brute_print(text, width=3):
    w = (text or "").encode().lower().split()
    grams = [w[i : i + width] for i in range(len(w) - width + 1)] if len(w) >= width else [w] * bool(w)
    hs = [xxhash.xxh64_intdigest(b" ".join(g), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_groups(prints):
    """prints: (doc_id, fp) rows to the least id reached."""
    left, out = set(range(len(prints))), {}
    while left:
        todo = [left.pop()]
        group = set(todo)
        while todo:
            x = todo.pop()
            near = {y for y in left if (prints[x][1] ^ prints[y][1]).bit_count() <= 2}
            left -= near
            group |= near
            todo += near
        ids = [prints[x][0] for x in group if prints[x][0] is not None]
        for x in group:
            out[x] = min(ids) if ids else None
    return [out[k] for k in range(len(prints))]


def check(spark, rows):
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fp int")
    got = sorted((tuple(r) for r in simhash.near_copies(df).collect()), key=repr)
    prints = [(i, brute_print(t)) for i, t in rows]
    want = sorted(((i, f"{fp:016x}", c) for (i, fp), c in zip(prints, brute_groups(prints))), key=repr)
    assert got == want


def test_documents(spark, sf):
    check(spark, [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])


def test_odd_rows(spark):
    base = [f"w{k}" for k in range(400)]
    rows = [(9, None), (8, ""), (7, " \n"), (None, "a b"), (5, "A B"), (5, "A B"), (4, "one"), (3, "a  b\tc"), (None, None), (2, " ".join(base)), (1, " ".join([*base[:-1], "z"]))]
    check(spark, rows)
    assert simhash.near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_masks_cover_every_pair():
    looks = simhash.masks()
    for i in range(64):
        for j in range(64):
            assert any(not m & (1 << i | 1 << j) for m in looks)


def test_large_buckets_lose_no_link(spark):
    rng = random.Random(1)
    centre = rng.getrandbits(64)
    prints = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(600)}
    prints |= {rng.getrandbits(64) for _ in range(200)}
    rows = [(k, fp) for k, fp in enumerate(sorted(prints))]
    df = table(spark.createDataFrame([(k, simhash._signed(fp)) for k, fp in rows], "doc_id long, fp long"), "t")
    sizes = [max(np.unique(np.array([fp & m for _, fp in rows], np.uint64), return_counts=True)[1]) for m in simhash.masks()]
    assert max(sizes) > simhash.SMALL
    got = {r["fp"]: r["least"] for r in simhash.groups(df, df["doc_id"]).collect()}
    want = brute_groups(rows)
    assert [got[simhash._signed(fp)] for _, fp in rows] == want
    # buckets of the small way give the same
    assert simhash.SMALL == 32
