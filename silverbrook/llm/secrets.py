"""Secret scan with ownership frequency, in DataFrame functions only.

Candidates are found in whole texts with regular expressions. Where a match begins follows from the lengths of the
text between matches: splitting by the pattern and extracting by it give both in order. Candidate values are hashed
and counted over the whole corpus by distinct repository and distinct owner: a value that many owners hold was
copied from an example, a value of one or few owners looks live, in however many repositories. Besides the three base kinds the method adds
``opaque`` spans, long runs of mixed letters and digits, but only those that few owners hold.

All counting combines before the shuffle, first per (value, owner, repository), so a value held by a third of all
rows is one row per task. Only rows with candidates are shuffled, and of them only positions and hashes.

Null texts are empty and have no spans. Repeated rows get the same result each and count once as a repository.
A null doc_id or owner counts as one more repository or owner. No documents give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silverbrook.llm.common import materialize

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# kind: (order, pattern, group of the value, least length of the value)
KINDS = {
    "assign": (0, ASSIGN, 2, 6),
    "access": (1, "AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (2, "[0-9a-f]{24,}", 0, 24),
    "opaque": (3, "[A-Za-z0-9+/_=-]{20,}", 0, 20),
}
BASE = ("assign", "access", "hex")
EXAMPLE_OWNERS = 3  # a value that so many owners hold is an example


def _mixed(value: Column) -> Column:
    return value.rlike("[0-9]") & value.rlike("[a-z]") & value.rlike("[A-Z]")


def candidates(docs: DataFrame, kind: str) -> DataFrame:
    """(doc_id, _h, kind, start, end, value) for the matches of one kind that are long enough.

    ``docs`` has doc_id, _h and text and no row twice.
    """
    order, pattern, group, least = KINDS[kind]
    some = docs.where(F.col("text").rlike(pattern))
    found = some.select("doc_id", "_h", F.posexplode(F.arrays_zip(
        F.split("text", pattern, -1).alias("gap"),
        F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("match"),
        F.regexp_extract_all("text", F.lit(pattern), F.lit(group)).alias("value"),
    )).alias("i", "m")).where("m.match IS NOT NULL")
    upto = Window.partitionBy("doc_id", "_h").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    width = F.length("m.match")
    placed = found.select("doc_id", "_h", F.col("m.value").alias("value"), width.cast("long").alias("width"), F.sum(
        F.length("m.gap") + width).over(upto).alias("end"))
    long_enough = F.length("value") >= least
    if kind == "opaque":
        long_enough &= _mixed(F.col("value"))
    return placed.where(long_enough).select(
        "doc_id", "_h", F.lit(kind).alias("kind"), F.lit(order).alias("order"), (F.col("end") - F.col("width")).alias(
            "start"), "end", F.xxhash64("value", F.length("value")).alias("hash"))


def ownership(spans: DataFrame, owner: str = "owner", repository: str = "doc_id") -> DataFrame:
    """(hash, owners, repositories): how many distinct owners and repositories hold each value."""
    once = spans.groupBy("hash", owner, repository).agg(F.lit(1).alias("one"))
    by_owner = once.groupBy("hash", owner).agg(F.count("*").alias("n"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))


def _joined(kinds: tuple[str, ...] | None) -> Column:
    spans = F.col("spans")
    if kinds:
        spans = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, owner: str = "source", example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, owner column): counts per base kind, spans, and how many values look live.

    The columns are doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live and n_example; the last two
    count base and added spans whose value fewer than, or at least, ``example_owners`` owners hold.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.col(owner).cast("string").alias("owner")).withColumn(
        "_h", F.xxhash64("text"))
    any_kind = reduce(lambda a, b: a | b, (F.col("text").rlike(p) for _, p, _, _ in KINDS.values()))
    some = materialize(rows.where(any_kind).dropDuplicates(["doc_id", "_h", "owner"]), "secret-texts")
    texts = some.dropDuplicates(["doc_id", "_h"]).select("doc_id", "_h", "text")
    spans = materialize(reduce(DataFrame.unionByName, (candidates(texts, k) for k in KINDS)), "secret-spans")
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["_h"] == b["_h"])
    owners = some.select(F.col("doc_id"), F.col("_h"), "owner")
    owned = spans.join(owners, same(spans, owners)).select(spans["doc_id"], "hash", "owner")
    judged = spans.join(ownership(owned), "hash").withColumn("live", F.col("owners") < example_owners).where(
        F.col("kind").isin(*BASE) | F.col("live"))
    found = judged.groupBy("doc_id", "_h").agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in BASE],
        F.array_sort(F.collect_list(F.struct("start", "order", "end", "kind"))).alias("spans"),
        F.count_if("live").alias("n_live"), F.count_if(~F.col("live")).alias("n_example"))
    found = found.select(
        F.col("doc_id").alias("_id"), F.col("_h").alias("_g"), *[f"n_{k}" for k in BASE],
        _joined(BASE).alias("base"), _joined(None).alias("spans"), "n_live", "n_example")
    out = rows.select("doc_id", "_h").join(
        found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_g")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select(
        "doc_id", *[zero(f"n_{k}") for k in BASE], F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"), zero("n_live"), zero("n_example"))
