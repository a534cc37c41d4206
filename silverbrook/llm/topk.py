"""Exact top-k inner products by no-random-access aggregation of sorted lists.

Candidates are dealt by hash into blocks of bounded size, queries into blocks too; every pair of blocks is one Spark
group. In a group each component gives one list of the candidates sorted by it. A query reads its lists from the end
that its sign prefers, all to the same depth, and keeps for every candidate the sum of what was read. What was not
read is at most the value at the list's frontier and at least the value at its far end, which bounds every
candidate's score from above and below. Reading stops once few candidates have an upper bound that reaches the
k-th lower bound; their scores are then resolved. The best of all blocks are merged by rank.

Vectors that are null, or hold null or non-finite components, and rows without an id take no part. Rows equal in id and
quantised vector travel as one row with their number, but count as so many candidates and queries: a query leaves out
its own row only, neither its copies nor other rows of its id. Ties go to the smaller id; a score that a long cannot hold counts as the largest or smallest long. Vectors are compared with those of equal dimension. No rows, no result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CANDIDATES, QUERIES = 8_192, 512  # rows per block, about
ENOUGH = 48  # so few possible candidates are resolved at once
DEPTHS = (4, 6, 8)  # eighths of the lists after which the bounds are looked at
REPEATS = 65_536  # copies of a row made at once
EXACT = {np.float32: 1 << 24, np.float64: 1 << 53}  # whole numbers below are exact


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, q, n): usable vectors with components floor(scale * x), and the number of equal rows."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & F.coalesce(finite, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long")).alias("q")).groupBy("vec_id", "q").agg(F.count("*").alias("n"))


def _repeated(rows: DataFrame, n: str) -> DataFrame:
    """Every row as often as its column ``n`` says, which is dropped."""
    some = rows.withColumn("_i", F.explode(F.sequence(F.lit(0), F.floor((F.col(n) - 1) / REPEATS))))
    left = F.least(F.lit(REPEATS), F.col(n) - F.col("_i") * REPEATS)
    return some.withColumn("_i", F.explode(F.sequence(F.lit(1), left.cast("int")))).drop("_i", n)


class SortedLists:
    """The candidates of a block, once per component, sorted by it."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, kind: type):
        n = len(ids)
        self.ids, self.rows, self.kind = ids, rows, kind  # no row of an id twice
        self.order = np.argsort(rows, axis=0, kind="stable").T.copy()  # component x rank
        self.values = np.take_along_axis(rows.T, self.order, axis=1).astype(kind)
        self.rank = np.empty(self.order.shape, np.uint16 if n <= 1 << 16 else np.int64)  # component x candidate
        np.put_along_axis(self.rank, self.order, np.arange(n, dtype=self.rank.dtype)[None, :], axis=1)

    def top(self, query: np.ndarray, allowed: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The k best (position, score) of those ``allowed``."""
        n, sign = len(self.ids), query > 0
        weight = query.astype(self.kind)
        worst = np.where(sign, self.values[:, 0], self.values[:, -1]) * weight
        known, depth, alive = np.zeros(n), 0, np.flatnonzero(allowed)
        for share in DEPTHS:
            upto = -(-n * share // 8)
            if len(alive) <= max(ENOUGH, k) or upto <= depth:
                continue
            for part, list_end in ((sign, slice(n - upto, n - depth)), (query < 0, slice(depth, upto))):
                gain = self.values[part, list_end] * weight[part, None]
                known += np.bincount(self.order[part, list_end].ravel(), gain.ravel(), n)
            depth = upto
            frontier = np.where(sign, self.values[:, n - depth], self.values[:, depth - 1]) * weight
            unseen = np.where(sign[:, None], self.rank < n - depth, self.rank >= depth)
            above, below = np.stack([frontier, worst]) @ unseen.astype(self.kind) + known
            floor = np.partition(below[allowed], -k)[-k]
            alive = np.flatnonzero(allowed & (above >= floor))
        score = self.rows[alive] @ query
        best = np.lexsort((self.ids[alive], -score))[:k]
        return [(int(alive[i]), int(score[i])) for i in best]


def _search(k: int):
    def search(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(candidates) and len(queries):
            rows, wanted = (np.stack(f["q"].to_list()) for f in (candidates, queries))
            ids, copies = candidates["vec_id"].to_numpy(), candidates["n"].to_numpy()
            size = int(np.abs(rows).max(initial=0)) * int(np.abs(wanted).max(initial=0)) * max(1, rows.shape[1])
            kind = next((t for t, limit in EXACT.items() if size < limit), None)
            lists = SortedLists(ids, rows, kind) if kind else None
            exact = None if kind else rows.astype(object)  # doubles could round, so whole numbers without bounds
            for q, query, same, asked in zip(wanted, queries["vec_id"], queries["same"], queries["n"], strict=True):
                mine = copies.copy()
                for i in np.flatnonzero(ids == query):
                    mine[i] -= np.array_equal(rows[i], q)
                if lists:
                    best = lists.top(q, mine > 0, k)
                else:
                    best = sorted(((i, int(s)) for i, s in enumerate(exact.dot(q.astype(object))) if mine[i]),
                                  key=lambda r: (-r[1], ids[r[0]]))[:k]
                out.extend((query, same, asked, ids[i], max(-(1 << 63), min((1 << 63) - 1, s)), min(k, mine[i])) for i, s in best)
        return pd.DataFrame(out, columns=["query_id", "same", "asked", "vec_id", "score", "n"])

    return search


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, candidates: int = CANDIDATES,
          queries: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score) for every query, each row whose id is divisible by ``every``."""
    rows = quantised(vectors).withColumn("dim", F.size("q"))
    rows = rows.withColumn("same", F.xxhash64("vec_id", "q"))
    asked = rows.where(F.col("vec_id") % every == 0)
    n, m = rows.count(), asked.count()
    c_blocks, q_blocks = max(1, -(-n // candidates)), max(1, -(-m // queries))
    key = ["dim", "c", "b"]
    left = rows.withColumn("c", F.pmod("same", F.lit(c_blocks))).withColumn(
        "b", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    right = asked.withColumn("b", F.pmod(F.xxhash64("same"), F.lit(q_blocks)).cast("int")).withColumn(
        "c", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(c_blocks - 1).cast("long"))))
    found = left.select(*key, "vec_id", "q", "n").groupBy(*key).cogroup(
        right.select(*key, "vec_id", "q", "same", "n").groupBy(*key)).applyInPandas(
        _search(k), "query_id long, same long, asked long, vec_id long, score long, n long")
    rank = F.row_number().over(Window.partitionBy("query_id", "same").orderBy(F.desc("score"), "vec_id"))
    best = _repeated(found, "n").withColumn("rank", rank).where(F.col("rank") <= k)
    return _repeated(best.select("query_id", "rank", "vec_id", "score", "asked"), "asked")
