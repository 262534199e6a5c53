import random
from itertools import combinations

import numpy as np
import pytest

from lodeweave.llm import similar

COLUMNS = "doc_id long, text string, source string"


def shingles(text, width=5):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    return {tuple(w[i : i + width]) for i in range(max(len(w) - width + 1, 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else float(not a and not b)


def brute_least(rows, similarity=0.8):
    """The least id of each row's group."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        if min(len(sets[i]), len(sets[j])) >= similarity * max(len(sets[i]), len(sets[j])) and jaccard(sets[i], sets[j]) >= similarity:
            root[find(i)] = find(j)
    groups = {}
    for k, (i, _) in enumerate(rows):
        groups.setdefault(find(k), []).append(i)
    return [min((i for i in groups[find(k)] if i is not None), default=None) for k in range(len(rows))]


def kept(spark, rows, **more):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], COLUMNS)
    return sorted(r["doc_id"] for r in similar.keep_one(df, **more).collect())


def changed(words, similarity, rng):
    """A copy of ``words`` with single words replaced until the shingles agree by just ``similarity`` or more."""
    out = list(words)
    for k in rng.sample(range(len(words)), len(words)):
        was, out[k] = out[k], f"new{rng.getrandbits(40)}"
        if jaccard(shingles(" ".join(words)), shingles(" ".join(out))) < similarity:
            out[k] = was
            return out
    return out


def test_documents_against_brute_force(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert kept(spark, rows) == sorted(set(brute_least(rows)))


def test_planted_copies(spark):
    rng = random.Random(5)
    rows, at = [], {}
    for s in (0.8, 0.9, 0.95):
        at[s] = []
        for k in range(120):
            base = [f"w{rng.getrandbits(30)}" for _ in range(rng.randint(120, 500))]
            i = len(rows)
            rows += [(i, " ".join(base)), (i + 1, " ".join(changed(base, s, rng)))]
            at[s].append(i + 1)
    left = set(kept(spark, rows))
    assert all(i in left for i in range(0, len(rows), 2))
    caught = {s: sum(i not in left for i in ids) / len(ids) for s, ids in at.items()}
    assert caught[0.8] >= 0.9 and caught[0.9] >= 0.97 and caught[0.95] == 1


@pytest.mark.parametrize("large", [4, 40])
def test_large_buckets(spark, large):
    """Hundreds of copies of one text, dealt again and in blocks, and pairs of another kind that stay apart."""
    rng = random.Random(6)
    base = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(changed(base, 0.95, rng))) for k in range(300)]
    for k in range(300, 360, 2):
        other = [f"v{rng.getrandbits(30)}" for _ in range(200)]
        rows += [(k, " ".join(other)), (k + 1, " ".join(changed(other, 0.92, rng)))]
    got = kept(spark, rows, large=large)
    want = sorted(set(brute_least(rows)))
    assert set(want) <= set(got)
    assert len(got) - len(want) <= 2


def test_any_two_prints_of_a_large_bucket_meet(spark):
    """Cut into blocks or not, the same pairs of prints share a bucket, and none is over twice the bound."""
    how, rng = similar.Plan(20, 1, 2, 35), random.Random(8)
    rows = sorted({(rng.choice((0, 5, 77)) | 1 << rng.randrange(20) | 1 << rng.randrange(20, 40), rng.getrandbits(60)) for _ in range(150)})
    units = spark.createDataFrame(rows, "w0 long, w1 long")

    def meetings(large):
        held = {}
        for r in similar.buckets(units, how, large).collect():
            held.setdefault(r["name"], []).append((r["w0"], r["w1"]))
        return {tuple(sorted(p)) for b in held.values() for p in combinations(b, 2)}, max(len(b) for b in held.values())

    whole, most = meetings(10**6)
    cut, bounded = meetings(16)
    assert cut == whole and most > 32 >= bounded


def test_plan_reaches_recall_at_every_size():
    for n in (0, 1, 1000, 10**6, 10**8, 10**10):
        how = similar.plan(n)
        p = similar.differing(0.8)
        assert 1 - (1 - similar.chance(how.bits, how.radius, p)) ** how.parts >= similar.RECALL
        tables = [t for part in how.masks() for t in part]
        assert min(sum(m.bit_count() for m in t.values()) for t in tables) >= min(17, how.bits // 2)


def test_masks_cover_the_radius():
    how = similar.Plan(20, 2, 2, 35)
    for part, tables in enumerate(how.masks()):
        for i, j in combinations(range(part * 20, part * 20 + 20), 2):
            assert any(not t.get(0, 0) & (1 << i | 1 << j) for t in tables)


def test_forests_join_what_pairs_join():
    rng = np.random.default_rng(7)
    centres = rng.integers(0, 1 << 63, (4, 2), dtype=np.uint64)
    a = np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, (25, 2), dtype=np.uint64)) for c in centres])
    rng.shuffle(a)

    def groups(edges):
        root = list(range(len(a)))
        for i, j in edges:
            old, new = root[i], root[j]
            root = [new if r == old else r for r in root]
        return [root.index(r) for r in root]

    close = [(i, j) for i, j in combinations(range(len(a)), 2) if np.bitwise_count(a[i] ^ a[j]).sum() <= 3]
    assert groups(similar._forest(a, 3)) == groups(close)
    name = np.repeat(np.arange(4), 25)
    inside = [(i, j) for i, j in close if name[i] == name[j]]
    assert groups(similar._small_forests(name, a, 3)) == groups(inside)


def test_odd_rows(spark):
    base = " ".join(f"w{k}" for k in range(300))
    rows = [(3, base, "x"), (2, base, "y"), (2, base, "y"), (2, base.upper(), "a"), (None, "other words here", "z"), (9, "q " * 30, None), (7, "", "e"), (6, None, "e"), (8, " \n", "e")]
    df = spark.createDataFrame(rows, COLUMNS)
    got = similar.keep_one(df)
    assert got.columns == df.columns
    assert sorted((r["doc_id"] or -1) for r in got.collect()) == [-1, 2, 6, 9]
    assert similar.keep_one(df.limit(0)).count() == 0
