"""The trie against a brute-force version over lists of turns."""

import hashlib
import random
import re
import zlib

from lodeweave.llm import turn_trie

COLS = "conv_id long, turn long, role string, text string, depth int, name string, kind int, weight int, head int"
OUT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, 3, 4) for r in rows], COLS)


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    full = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        full[c] = tuple(own.get(base, [])[:h] + ts[h:])
    members = {}
    for c, s in full.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    n_words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    out = []
    for p, cs in members.items():
        below = [q for q in members if q[: len(p)] == p]
        kids = [q for q in below if len(q) == len(p) + 1]
        leaves = [q for q in below if not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in below)]
        saved = sum((len(members[q]) - 1) * n_words(q[-1][1]) for q in below if q)
        ends = ",".join(map(str, sorted(c for c in cs if full[c] == p)))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def built(spark, rows):
    got = turn_trie.trie(frame(spark, rows))
    assert tuple(got.columns) == OUT
    return sorted((tuple(r) for r in got.collect()), key=repr)


def test_brute_force(spark):
    r = random.Random(5)
    rows = []
    for c in [*range(0, 160), *range(-45, -1), 10**12, 10**12 + 3]:
        rows += [(c, t, r.choice(["user", "assistant"]), r.choice(["a b", "a b", "c  d e", "f"])) for t in range(r.randrange(1, 7))]
    assert built(spark, rows) == brute(rows)


def test_one_conversation_common(spark, monkeypatch):
    """Many copies of one conversation, in end lists of many pieces."""
    monkeypatch.setattr(turn_trie, "PIECE_BITS", 3)
    rows = [(c, t, "user", f"word {t}") for c in range(0, 400) for t in range(4)] + [(c, t, "user", f"word {t}") for c in range(1000, 1020) for t in range(2 + c % 3)]
    assert built(spark, rows) == brute(rows)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(turn_trie, "OUT_ROWS", 7)
    rows = [
        (None, 1, "user", "x"), (1, None, None, None), (1, 1, "user", ""), (1, 1, "user", ""), (1, 1, "assistant", "y"), (2, 1, "user", "x" * 100_000), (3, 1, "user", " \t\n"),
        (20, 1, "user", None), (20, 1, None, "user"), (21, 5, "", "user"), (22, 1, "user", "a:b"), (23, 1, "user:a", "b"), (24, 1, "use", "ra:b"),
    ]
    rows += [(40, t, "user", f"long {t}") for t in range(60)] + [(41, t, "user", f"long {t}") for t in range(50)]
    assert built(spark, rows) == brute(rows)
    assert built(spark, []) == []
    assert built(spark, [(None, 1, "user", "x")]) == []
