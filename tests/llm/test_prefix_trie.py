import hashlib
import random
import re
import zlib
from collections import defaultdict

from llm_compare import agree

from silverbrook.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn int, role string, text string"


def plain(rows):
    """Node by node from all sequences: {(depth, smallest member): the other columns}."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    seq = {c: [r[2:] for r in sorted(t)] for c, t in own.items()}
    new = {}
    for c, t in seq.items():
        h, base = zlib.crc32(str(c).encode()) % 4, c - (c % 20 if c >= 0 else -(-c % 20))
        new[c] = tuple(seq.get(base, [])[:h] + t[h:])
    members = defaultdict(list)
    for c, t in new.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)

    out = {}
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        below = [out[k] for k in kids[p]]
        ends = ",".join(map(str, sorted(c for c in members[p] if new[c] == p)))
        out[p] = (min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids[p]),
                  sum(b[5] for b in below) or 1, sum(b[6] for b in below) + (len(members[p]) - 1) * words,
                  hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=lambda r: r[:2])


def check(spark, rows):
    got = [tuple(r) for r in pt.prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got, key=lambda r: r[:2]) == plain(rows)


def test_with_sql(spark, small):
    agree(spark, small, "op13_prefix_trie")


def test_random_and_long_conversations(spark):
    rng, rows = random.Random(3), []
    for c in rng.sample(range(-60, 400), 160):
        for t in range(rng.choice([1, 2, 3, 7, 8, 9, 16, 17, 40])):
            rows.append((c, t, rng.choice(["user", "assistant"]), "same words here" if rng.random() < 0.9 else "x y"))
    long = [(t, "user", f"turn {t}") for t in range(150)]
    for c in (500, 501, 502, 520, 521):  # copies that part late
        rows += [(c, *r) for r in long[:rng.choice([150, 130])]] + [(c, 200, "user", rng.choice("ab"))]
    check(spark, rows)


def test_many_copies_in_several_chunks(spark, monkeypatch):
    monkeypatch.setattr(pt, "CHUNK", 7)
    check(spark, [(c, t, "user", f"hello {t}") for c in range(1, 300) for t in range(4)])


def test_odd_rows(spark):
    rows = [(None, 1, "user", "lost"), (3, None, None, None), (3, 1, "user", None), (3, 1, "user", None), (4, 2, "a", "b c"),
            (4, 2, "a", "b"), (4, None, "z", "first"), (5, 1, "ab", "c"), (6, 1, "a", "bc"), (7, 1, "user", "w " * 100_000),
            (20, 1, "user", ""), (-3, 1, "user", "minus")]
    check(spark, rows)
    check(spark, [(None, 1, "user", "lost")])
    check(spark, [(21, 0, "u", "only")])
    wide = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", pos int, key string")
    assert pt.prefix_trie(wide).count() == len(plain(rows))
    assert pt.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
