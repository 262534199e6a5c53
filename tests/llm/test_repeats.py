import hashlib
import random
from collections import Counter

from lodeweave.llm.repeats import remove_repeats

SCHEMA = "doc_id long, text string, n_words string, rid int"


def brute(rows, width):
    docs = [(i, (t or "").encode().split()) for i, t, *_ in rows]
    seen = Counter(tuple(w[p : p + width]) for _, w in docs for p in range(len(w) - width + 1))
    out = []
    for i, w in docs:
        gone = set()
        for p in range(len(w) - width + 1):
            if seen[tuple(w[p : p + width])] > 1:
                gone.update(range(p, p + width))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows, width=35):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    got = remove_repeats(df, width).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    return sorted((tuple(r) for r in got), key=repr)


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"w{k}" for k in range(40)]
    passages = [[rng.choice(vocab) for _ in range(rng.randint(30, 90))] for _ in range(6)]
    rows = []
    for i in range(120):
        w = []
        for _ in range(rng.randint(0, 4)):
            w += [rng.choice(vocab) for _ in range(rng.randint(0, 40))]
            if rng.random() < 0.5:
                p = rng.choice(passages)
                a = rng.randint(0, 20)
                w += p[a : a + rng.randint(20, 80)]
        rows.append((i, rng.choice([" ", "\n", "\t \u000b"]).join(w)))
    assert run(spark, rows) == brute(rows, 35)
    assert run(spark, rows, 5) == brute(rows, 5)


def test_runs_copies_nulls_and_ends(spark):
    base = " ".join(f"x{k}" for k in range(35))
    rows = [
        (1, None), (2, ""), (3, " \n "), (4, base), (5, base), (5, base), (None, base + " end"), (None, None),
        (6, "a " * 34), (7, "b " * 36), (8, "c " * 35), (9, "ab cd " * 60), (10, "d " * 500 + "e " + "d " * 500),
        (11, "only once " + " ".join(f"y{k}" for k in range(3000))), (12, "  word   x" * 20),
    ]
    assert run(spark, rows) == brute(rows, 35)


def test_empty_table(spark):
    assert run(spark, []) == []
