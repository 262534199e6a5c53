import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from lodeweave.llm import mixing, quality, shards

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_words int, shard string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "q") for r in rows], SCHEMA)


ODD = [(1, None, "en", "a"), (None, "", None, None), (2, "x " * 50, "en", "a"), (2, "x " * 50, "en", "a"), (3, "a b c\na b c\n \na b c", "de", None), (4, " ".join(f"w{k}" for k in range(3000)), None, "b"), (5, "p&q <b> 5$ #1 " + "é日本 " * 19, "fr", "b")]


def base(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    at = defaultdict(list)
    for p in range(len(w) - 7):
        at[tuple(w[p : p + 8])].append(p)
    covered = {p + k for ps in at.values() if len(ps) > 1 for p in ps for k in range(8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_base_counts(spark, sf):
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rng = random.Random(4)
    rows += [(1000 + k, " ".join(rng.choice("ab") for _ in range(60)), "en", "s") for k in range(30)] + ODD
    got = Counter((r["doc_id"], *[r[c] for c in quality.BASE], r["base_failed"]) for r in quality.score(frame(spark, rows)).collect())
    want = Counter((i, *(b := base(t)), b[0] < 20 or 100 * b[4] > 30 * b[0]) for i, t, _, _ in rows)
    assert got == want


def test_thresholds_follow_the_group(spark):
    rng = random.Random(1)
    clean = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "of"]) + str(rng.randint(0, 999)) for _ in range(80))
    rows = [(k, clean(), "en", "plain") for k in range(300)]
    rows += [(1000 + k, clean().replace(" ", " # "), "en", "code") for k in range(300)]
    rows += [(2000, clean().replace(" ", " # "), "en", "plain"), (2001, clean(), "en", "tiny")]
    kept = {r["doc_id"]: r["kept"] for r in quality.score(frame(spark, rows)).collect()}
    assert not kept[2000] and kept[2001]
    assert all(v for k, v in kept.items() if k != 2000)
    df = frame(spark, [*rows, *ODD])
    out = quality.keep_good(df)
    assert out.columns == df.columns and {r["doc_id"] for r in out.collect()} >= set(range(300))


def test_quality_empty(spark):
    assert quality.score(frame(spark, [])).count() == 0
    assert quality.keep_good(frame(spark, [])).count() == 0


def fill(sizes):
    """Targets by repeated sharing, as the contract words it."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        total = sum(weight[s] for s in free)
        share = {s: left * weight[s] / total for s in free} if total else {}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return {**fixed, **share}
        for s in over:
            fixed[s] = 2.0 * sizes[s]
            left -= fixed[s]


def test_mix(spark, sf):
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + ODD
    df = frame(spark, rows)
    got = [tuple(r) for r in mixing.mix(df).collect()]
    source = defaultdict(list)
    for i, t, _, s in rows:
        source[s].append(len(WORD.findall(t or "")))
    goal = fill({s: sum(v) for s, v in source.items()})
    assert Counter((r[0], r[1]) for r in got) == Counter((i, len(WORD.findall(t or ""))) for i, t, _, _ in rows)
    of = {(sum(v), round(goal[s], 3)): max(v) for s, v in source.items()}
    taken = Counter()
    for _, size, total, target, t in got:
        assert (total, round(target, 3)) in of and t <= 2 * size and (size == 0 or t % size == 0)
        taken[total, round(target, 3)] += t
    for (total, target), longest in of.items():
        assert abs(taken[total, target] - target) <= longest
    again = sorted((tuple(r) for r in mixing.mix(df.repartition(7)).collect()), key=repr)
    assert again == sorted(got, key=repr)
    out = mixing.take(df)
    assert out.columns == df.columns
    assert sum(len(WORD.findall(r["text"] or "")) for r in out.collect()) == sum(t for *_, t in got)


def test_unequal_inclusion(spark):
    """Longer documents are drawn more often, and certain copies come first."""
    rows = [(k, "w " * (2 if k % 2 else 500), "en", "a") for k in range(2000)] + [(5000, "w " * 2_000_000, "en", "b")]
    got = mixing.mix(frame(spark, rows)).collect()
    long = sum(r["taken"] > r["size"] for r in got if r["size"] == 500)
    short = sum(r["taken"] > r["size"] for r in got if r["size"] == 2)
    assert all(r["taken"] >= r["size"] for r in got if r["size"] <= 500) and long >= short


@pytest.mark.parametrize("rows", [[], [(1, None, None, None)], [(1, "", "en", "a")]])
def test_mix_small(spark, rows):
    assert mixing.mix(frame(spark, rows)).count() == len(rows)


def test_shards(spark, sf):
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + ODD
    check_shards(spark, rows, 1.25)
    check_shards(spark, [(k, f"same text {k if k > 700 else ''}", "en", "a") for k in range(1000)], 1.05)
    check_shards(spark, [], 1)
    check_shards(spark, [(1, "a", None, None), (None, None, None, None)], 9)


def check_shards(spark, rows, most):
    got = shards.shard(frame(spark, rows)).collect()
    enc = lambda t: (t or "").encode()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len(enc(t)) + 1, zlib.crc32(enc(t))) for i, t, _, _ in rows)
    by = defaultdict(list)
    for r in got:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 8
        by[r["shard"]].append(r)
    for v in by.values():
        assert sorted(r["slot"] for r in v) == list(range(len(v)))
    if rows:
        sizes = [sum(r["size"] for r in v) for v in by.values()]
        assert max(sizes) <= most * sum(sizes) / 8
