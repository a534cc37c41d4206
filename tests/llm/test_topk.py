import math
import random

import numpy as np
from llm_compare import agree

from silverbrook.llm import topk as tk

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows, k=5, every=50):
    good = [(i, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (i, q) in enumerate(good):
        if i % every == 0:
            found = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for other, (j, v) in enumerate(good)
                           if other != at and len(v) == len(q))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found[:k])]
    return sorted(out)


def shown(df):
    return sorted(tuple(r[c] for c in ("query_id", "rank", "vec_id", "score")) for r in df.collect())


def test_query_agrees_with_sql(spark, small):
    agree(spark, small, "op5_exact_topk")


def test_blocks_and_ties(spark, docs_of):
    rng = random.Random(8)
    rows = [(i, [round(rng.gauss(0, 0.3), 1) for _ in range(6)]) for i in range(700)]
    rows += [(1000 + i, [0.5, 0.5, 0.0, -0.5, 0.0, 0.1]) for i in range(400)]  # a very common vector
    rows += [(2000 + 50 * i, [0.0] * 6) for i in range(2)]
    want = plain(rows)
    assert shown(tk.top_k(docs_of(rows, SCHEMA))) == want
    assert shown(tk.top_k(docs_of(rows, SCHEMA), candidates=100, queries=7)) == want


def test_repeated_rows_are_rows(spark, docs_of, monkeypatch):
    rng = random.Random(9)
    rows = [(i, [round(rng.gauss(0, 0.3), 1) for _ in range(3)]) for i in range(120)]
    rows += rows[:60] + rows[:1] * 7 + rows[7:8] * 3 + [(50, [0.9, 0.9, 0.9]), (50, [-0.9, 0.1, 0.9])]
    want = plain(rows)
    assert sum(r[1] == 1 for r in want) == sum(i % 50 == 0 for i, _ in rows) == 3 + 2 + 7 + 2
    assert shown(tk.top_k(docs_of(rows, SCHEMA))) == want
    monkeypatch.setattr(tk, "REPEATS", 2)
    assert shown(tk.top_k(docs_of(rows, SCHEMA), candidates=20, queries=2)) == want
    far = [(0, [1e5, 1.0])] * 3 + [(1, [2e6, 0.5])] * 2
    assert shown(tk.top_k(docs_of(far, SCHEMA))) == plain(far)


def test_odd_rows(spark, docs_of):
    rows = [(0, [0.1, 0.2]), (0, [0.1, 0.2]), (1, None), (2, [0.1, None]), (3, [float("nan"), 0.0]), (4, [float("inf"), 0.0]),
            (None, [0.1, 0.1]), (50, [0.3, -0.4]), (51, [0.9, 0.9, 0.9]), (100, [0.2, 0.2, 0.2]), (52, []), (150, [])]
    assert shown(tk.top_k(docs_of(rows, SCHEMA))) == plain(rows)
    assert shown(tk.top_k(docs_of([(50, [1.0])], SCHEMA))) == []
    assert shown(tk.top_k(docs_of([], SCHEMA))) == []
    wide = docs_of([(0, [1.0], 3, 4), (7, [0.5], 5, 6)], f"{SCHEMA}, score int, rank int")
    assert shown(tk.top_k(wide)) == [(0, 1, 7, 256 * 128)]


def test_huge_components(spark, docs_of):
    rows = [(0, [3e5, 1.0]), (1, [2e6, 0.5]), (2, [-2e6, 0.5]), (3, [2e6, 0.75])]
    got = shown(tk.top_k(docs_of(rows, SCHEMA)))
    assert [g[2] for g in got] == [3, 1, 2] and got == plain(rows)
