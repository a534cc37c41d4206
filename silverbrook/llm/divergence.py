"""Divergence of sources within a language, by term counts, and the terms that make a source stand out.

Every partition counts the terms of its documents once; counts are summed by Spark. Pairs of sources are compared
in blocks of ``SIDE`` sources each, a slice of the vocabulary per task, with whole arrays; only the sums leave a task.

The terms of a source are ranked by a dominance skyband. A term's value rises with its count in the source and falls
with its count in the language, ties go to the earlier term in UTF-8. A term that ``TOP`` others dominate in all three
cannot be among the first ``TOP``. Each slice of a source's terms keeps those that fewer than ``TOP`` others dominate;
the slices' skybands are merged into the source's skyband, whose few terms are ranked by their exact value. Counting
dominators within the kept terms is enough: the first ``TOP`` dominators of a term, in order of dominance, are kept.

Null text, lang and source count as empty. Repeated documents count again. Every (lang, source) that occurs is a group,
with or without terms. Only the three columns are read. No documents: no rows. All arithmetic is on integers; it is
exact up to 9 * 10^13 terms a language. Long texts count like any other, one text in memory at a time.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silverbrook.llm.common import materialize, rows_of

MIN_DOCS = 10
TOP = 10
SCALE = 1_000_000_000
SIDE = 256
SLICES = 64
SLICE_TERMS = 20_000
HELD = 300_000

# One byte each: a-z and all bytes of non-ASCII characters stay, A-Z become a-z, the rest separates.
_TERM_BYTES = bytes(
    b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """Rows (lang, source, term, n, n_docs): occurrences and documents of every term in every group."""
    def count(batches):
        counts, docs_of, held = defaultdict(Counter), defaultdict(Counter), 0

        def flush():
            for group, terms in counts.items():
                n = docs_of[group]
                for at in range(0, len(terms), 50_000):
                    some = list(terms)[at:at + 50_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([group[0]] * len(some)), pa.array([group[1]] * len(some)),
                         pa.array([t.decode() for t in some]), pa.array([terms[t] for t in some], pa.int64()),
                         pa.array([n[t] for t in some], pa.int64())], ["lang", "source", "term", "n", "n_docs"])
            counts.clear()
            docs_of.clear()

        for lang, source, text in rows_of(batches, "lang", "source", "text"):
            if not text:
                continue
            found, group = text.encode().translate(_TERM_BYTES).split(), (lang or "", source or "")
            terms = counts[group]
            held -= len(terms)
            terms.update(found)
            held += len(terms)
            docs_of[group].update(set(found))
            if held > HELD:
                yield from flush()
                held = 0
        yield from flush()

    rows = docs.select("lang", "source", "text").mapInArrow(
        count, "lang string, source string, term string, n long, n_docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / total), in two steps that stay within 64 bits."""
    a = counts + 2
    whole, rest = np.divmod(a * 100_000, total)
    return 1 + whole * 10_000 + rest * 10_000 // total


def _share(count: str, total: str) -> Column:
    """The same as a column."""
    return F.expr(f"1 + (cast({SCALE} as decimal(10, 0)) * cast({count} + 2 as decimal(18, 0)))"
                  f" div cast({total} as decimal(18, 0))")


def _gap(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def skyband(rows: DataFrame, keys: list[str], k: int = TOP) -> DataFrame:
    """Rows (lang, source, term, n, lang_n, ...) that fewer than ``k`` others of their ``keys`` dominate.

    Rows come sorted so that dominators precede what they dominate; one key's kept rows are in memory at a time.
    """
    order = [*keys, F.desc("n"), "lang_n", "term"]
    rows = rows.repartition(*keys).sortWithinPartitions(*order)

    def keep(batches):
        at, low, terms = None, np.empty(0, np.int64), np.empty(0, object)
        for batch in batches:
            names = list(zip(*(batch.column(c).to_pylist() for c in keys), strict=True))
            lang_n = batch.column("lang_n").to_numpy()
            utf8 = np.array([t.encode() for t in batch.column("term").to_pylist()], object)
            kept, start = [], 0
            while start < len(names):
                if names[start] != at:
                    at, low, terms = names[start], low[:0], terms[:0]
                end = start
                while end < len(names) and names[end] == at and end - start < 2048:
                    end += 1
                here = np.arange(start, end)
                if len(low) >= k:  # drop what the rows kept before already decide
                    dominated = ((low[None, :] <= lang_n[here, None]) & (terms[None, :] < utf8[here, None])).sum(axis=1)
                    here = here[dominated < k]
                for i in here.tolist():
                    if np.count_nonzero((low <= lang_n[i]) & (terms < utf8[i])) < k:
                        low, terms = np.append(low, lang_n[i]), np.append(terms, utf8[i:i + 1])
                        kept.append(i)
                start = end
            yield batch.take(pa.array(kept, pa.int64()))

    return rows.mapInArrow(keep, rows.schema)


def pair_sums(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows (lang, left, right, part, seen): the gap of every pair of a language's sources, and over how many terms.

    ``kept`` has (lang, term, sources: array of (id, n)), ``groups`` (lang, id, total, v); ``left`` < ``right`` are ids.
    A term goes to the blocks of pairs that one of its sources is in, its count elsewhere there being zero; in other
    blocks it is not seen. A task gets about ``SLICE_TERMS`` terms at a time, whatever the size of the vocabulary.
    """
    totals = groups.select("lang", F.floor(F.col("id") / SIDE).alias("side"), "id", "total")
    sides = totals.select("lang", F.col("side").alias("b")).distinct()
    slices = groups.groupBy("lang").agg((1 + F.expr(f"max(v) div {SLICE_TERMS}")).alias("slices"))
    rows = kept.withColumn("sides", F.array_distinct(F.transform("sources", lambda s: F.floor(s["id"] / SIDE))))
    rows = rows.withColumn("a", F.explode("sides")).join(sides, "lang").where(
        "a <= b OR NOT array_contains(sides, b)").join(slices, "lang")
    keys = ["lang", "a", "b", "slice"]
    rows = rows.select(
        "lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"),
        F.pmod(F.xxhash64("term"), F.col("slices")).alias("slice"), F.col("sources.id").alias("ids"),
        F.col("sources.n").alias("ns"))
    known = rows.select(*keys).distinct().join(totals, "lang").where("side = a OR side = b").select(
        *keys, "id", "total").toDF(*keys, "id", "total")

    def sums(key, terms: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        lang, a, b, _ = key
        known = known.sort_values("id")
        ids, totals = known["id"].to_numpy(), known["total"].to_numpy()
        of_a, of_b = np.flatnonzero(ids // SIDE == a), np.flatnonzero(ids // SIDE == b)
        acc, step = np.zeros((len(of_a), len(of_b)), np.int64), max(1, 1_000_000 // max(1, len(ids)))
        for at in range(0, len(terms), step):
            some, ns = terms["ids"].iloc[at:at + step], terms["ns"].iloc[at:at + step]
            term = np.repeat(np.arange(len(some)), [len(x) for x in some])
            source, n = np.concatenate(list(some)), np.concatenate(list(ns))
            here = np.isin(source, ids)
            counts = np.zeros((len(some), len(ids)), np.int64)
            counts[term[here], np.searchsorted(ids, source[here])] = n[here]
            p = shares(counts, totals[None, :])
            right = p[:, of_b]
            for r, i in enumerate(of_a.tolist()):
                left = p[:, i, None]
                acc[r] += ((left - right) ** 2 // (left + right)).sum(axis=0)
        left, right = np.meshgrid(ids[of_a], ids[of_b], indexing="ij")
        use = left < right
        return pd.DataFrame({"lang": lang, "left": left[use], "right": right[use], "part": acc[use], "seen": len(terms)})

    return rows.groupBy(*keys).cogroup(known.groupBy(*keys)).applyInPandas(
        sums, "lang string, left long, right long, part long, seen long").groupBy("lang", "left", "right").agg(
        F.sum("part").alias("part"), F.sum("seen").alias("seen"))


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): every source against the others and its ``top`` terms."""
    docs = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    groups = docs.groupBy("lang", "source").agg(F.count("*").alias("n_docs"))
    numbers = Window.partitionBy("lang").orderBy("source")
    groups = materialize(groups.select("lang", "source", (F.row_number().over(numbers) - 1).cast("long").alias("id")),
                         "groups")
    terms = term_counts(docs).join(groups, ["lang", "source"])
    kept = terms.groupBy("lang", "term").agg(
        F.sum("n_docs").alias("n_docs"), F.sum("n").alias("lang_n"), F.collect_list(F.struct("id", "n")).alias("sources"))
    kept = materialize(kept.where(F.col("n_docs") >= min_docs).drop("n_docs"), "kept-terms")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    each = kept.select("lang", "term", "lang_n", F.explode("sources").alias("s")).select(
        "lang", "term", "lang_n", F.col("s.id").alias("id"), F.col("s.n").alias("n"))
    sizes = groups.join(each.groupBy("lang", "id").agg(F.sum("n").alias("own")), ["lang", "id"], "left").join(
        langs, "lang", "left").select(
        "lang", "source", "id", F.coalesce("v", F.lit(0)).alias("v"),
        (F.coalesce("own", F.lit(0)) + 2 * F.coalesce("v", F.lit(0))).alias("total"),
        (F.coalesce("lang_total", F.lit(0)) + 2 * F.coalesce("v", F.lit(0))).alias("lang_total"))
    sizes = materialize(sizes, "sizes")

    scored = each.join(sizes.select("lang", "source", "id", "total", "lang_total"), ["lang", "id"])
    scored = scored.withColumn("p", _share("n", "total")).withColumn("q", _share("lang_n", "lang_total")).where(
        "p > q").select("lang", "source", "term", "n", "lang_n", "p", "q",
                        F.pmod(F.xxhash64("term"), F.lit(SLICES)).alias("slice"))
    local = skyband(scored, ["lang", "source", "slice"], top)
    best = skyband(local.drop("slice"), ["lang", "source"], top).select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _gap("p", "q").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    sums = materialize(pair_sums(kept, sizes.where("v > 0").select("lang", "id", "total", "v")), "pair-sums")
    sums = sums.unionByName(sums.select("lang", F.col("right").alias("left"), F.col("left").alias("right"), "part", "seen"))
    one = sizes.select("lang", "source", F.col("id").alias("left"), "v", F.col("total").alias("left_total"))
    two = sizes.select("lang", F.col("source").alias("item"), F.col("id").alias("right"), F.col("total").alias("right_total"))
    pairs = one.join(two, "lang").where("left <> right").join(sums, ["lang", "left", "right"], "left")
    zero = F.lit(0).cast("long")
    pairs = pairs.withColumn("zero", zero).withColumn(
        "p", F.when(F.col("v") > 0, _share("zero", "left_total"))).withColumn(
        "q", F.when(F.col("v") > 0, _share("zero", "right_total"))).withColumn(
        "value", F.coalesce(F.coalesce("part", zero) + (F.col("v") - F.coalesce("seen", zero)) * _gap("p", "q"), zero))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value",
                         F.row_number().over(order).alias("rank"))
    return pairs.unionByName(best)
