"""Ordered computations that stay parallel inside one large key.

A plain window puts all rows of a key into one task. Here each key is cut into chunks of
the ordering (for example by hour or day), the window runs per (key, chunk), and what a
chunk needs from earlier ones is carried over as one small row per chunk. Null keys form a
key of their own and null orders come first, as in a window.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silverbrook.session import materialize


def _chunked(df: DataFrame, keys: Sequence[str], chunk: Column):
    rows = df.withColumn("_chunk", chunk)
    return rows, [*keys, "_chunk"]


def _with_carry(local: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each row with its chunk's carried row; null keys and chunks meet their own."""
    renamed = carry.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                           *[c for c in carry.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return local.join(renamed, same).drop(*[f"_k{i}" for i in range(len(keys))])


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column,
                  chunk: Column, name: str) -> DataFrame:
    """Running sum of ``value`` per key in ``order``; ``order`` must be unique per key."""
    rows, chunk_keys = _chunked(df.withColumn("_value", value), keys, chunk)
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        rows.groupBy(*chunk_keys).agg(F.sum("_value").alias("_sum"))
        .select(*chunk_keys, F.sum("_sum").over(before).alias("_carry"))
    )
    inside = Window.partitionBy(*chunk_keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("_local", F.sum("_value").over(inside))
    # Either part is null as long as it has seen no value.
    total = F.coalesce(F.col("_local") + F.col("_carry"), "_local", "_carry")
    return _with_carry(local, carry, chunk_keys).withColumn(name, total).drop(
        "_chunk", "_value", "_local", "_carry")


def previous_value(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str,
                   chunk: Column, name: str) -> DataFrame:
    """Value of the row before, per key in ``order``; null on the first row.

    Inside a chunk this is a plain lag. Only the first and last rows of the chunks, at
    most two each, go through a second lag per key, where a chunk's first row follows
    the last row of the chunk before it.
    """
    rows, chunk_keys = _chunked(df, keys, chunk)
    inside = Window.partitionBy(*chunk_keys).orderBy(*order)
    local = (
        rows.withColumn(name, F.lag(value).over(inside))
        .withColumn("_first", F.row_number().over(inside) == 1)
        .withColumn("_last", F.lead(F.lit(1)).over(inside).isNull())
    )
    ends = local.filter("_first OR _last").withColumn(
        name, F.lag(value).over(Window.partitionBy(*keys).orderBy("_chunk", *order)))
    return local.filter("NOT _first").unionByName(ends.filter("_first")).drop("_chunk", "_first", "_last")


def row_numbers(df: DataFrame, keys: Sequence[str], bands: Sequence[str], order: Sequence[str],
                name: str) -> DataFrame:
    """Row number per key by ``bands`` descending, then ``order`` ascending.

    Rows are numbered inside each band; how many rows the higher bands hold is added from
    one small count per band. A key with very many rows is thus split over its bands.
    """
    chunk_keys = [*keys, *bands]
    above = Window.partitionBy(*keys).orderBy(*[F.desc(b) for b in bands]).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        df.groupBy(*chunk_keys).agg(F.count(F.lit(1)).alias("_n"))
        .select(*chunk_keys, F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_above"))
    )
    inside = Window.partitionBy(*chunk_keys).orderBy(*order)
    local = df.withColumn("_local", F.row_number().over(inside))
    return _with_carry(local, carry, chunk_keys).withColumn(name, F.col("_local") + F.col("_above")).drop(
        "_local", "_above")


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, value: Sequence[str],
              chunk) -> DataFrame:
    """Latest ``right`` row at or before each ``left`` row, per key.

    Both sides carry the time column ``at``; ``chunk`` maps it to the chunk it lies in.
    ``value`` are the right-side columns to bring over, prefixed ``asof_``. A left row with a null
    key or time stays and finds nothing.
    """
    usable = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*keys, at)])
    right = right.filter(usable)
    payload = F.struct(F.col(at).alias("at"), *value)
    events = left.filter(usable).withColumn("_side", F.lit(1)).withColumn("_hit", F.lit(None).cast(
        right.select(payload.alias("p")).schema["p"].dataType))
    states = right.select(*keys, at, payload.alias("_hit")).withColumn("_side", F.lit(0))
    rows, chunk_keys = _chunked(events.unionByName(states, allowMissingColumns=True), keys, chunk(F.col(at)))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        rows.groupBy(*chunk_keys).agg(F.max("_hit").alias("_last"))
        .select(*chunk_keys, F.max("_last").over(before).alias("_carry"))
    )
    inside = Window.partitionBy(*chunk_keys).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("_seen", F.max("_hit").over(inside)).filter(F.col("_side") == 1)
    found = F.coalesce("_seen", "_carry")
    matched = _with_carry(local, carry, chunk_keys).select(
        *left.columns, found["at"].alias(f"asof_{at}"), *[found[v].alias(f"asof_{v}") for v in value])
    kinds = {f.name: f.dataType for f in matched.schema.fields}
    lone = left.filter(~usable).select(*left.columns, *[
        F.lit(None).cast(kinds[f"asof_{v}"]).alias(f"asof_{v}") for v in (at, *value)])
    return matched.unionAll(lone)


def _micros(ts: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts)


# Ranges below 2^20 microseconds, about a second, share one level.
_FINEST = 20


def range_join(points: DataFrame, ranges: DataFrame, keys: Sequence[str], at: str,
               start: str, end: str) -> DataFrame:
    """Pairs with ``start <= at < end`` and equal keys.

    A range lies in at most two blocks of the smallest power of two that is no shorter than itself, so it
    becomes two rows at most, whether it lasts seconds or years. A point becomes one row for each such length that
    occurs, sixty at most. The join is an equality on key, level and block, which spreads one busy key. Empty
    ranges and rows with a null key or time find nothing.
    """
    first, last = _micros(F.col(start)), _micros(F.col(end)) - 1
    # the bits of the length decide; the binary text of a number has as many digits
    level = F.greatest(F.length(F.bin(last - first)), F.lit(_FINEST))
    cut = ranges.where(F.col(start) < F.col(end)).withColumn("_level", level)
    block = [F.call_function("shiftright", x, F.col("_level")) for x in (first, last)]
    cut = cut.withColumn("_block", F.explode(F.array_distinct(F.array(*block))))
    levels = sorted(r[0] for r in cut.select("_level").distinct().collect())
    marked = points.where(F.col(at).isNotNull()).withColumn("_level", F.explode(F.array(
        *[F.lit(n) for n in levels]).cast("array<int>"))).withColumn(
        "_block", F.call_function("shiftright", _micros(F.col(at)), F.col("_level")))
    joined = marked.join(cut, [*keys, "_level", "_block"])
    return joined.filter((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_level", "_block")


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probabilities: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles per key, one column for each name in ``probabilities``.

    Distinct values are counted and sorted by range over all tasks; the sum of the counts before each piece of a key
    gives the ranks it holds, and only the pieces that hold a wanted rank are looked into. No task holds more
    than its piece, however many distinct values a key has. Null values do not count; a key without others is null.
    """
    counted = df.groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(value).alias("_n"))
    counted = counted.repartitionByRange(*keys, "_v").withColumn("_part", F.spark_partition_id())
    counted = materialize(counted, "counted")
    pieces = counted.groupBy(*keys, "_part").agg(F.sum("_n").alias("_size"), F.min("_v").alias("_low"))
    whole = Window.partitionBy(*keys)
    before = whole.orderBy(F.asc_nulls_first("_low")).rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0))).withColumn(
        "_total", F.sum("_size").over(whole))
    wanted = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), ((F.col("_total") - 1) * F.lit(float(p))).alias("at"))
                                 for n, p in probabilities.items()]))
    pieces = pieces.withColumn("_w", wanted).where(
        (F.ceil("_w.at") >= F.col("_before")) & (F.floor("_w.at") < F.col("_before") + F.col("_size")) & (F.col("_total") > 0))
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"p.{k}")) for k in keys] + [F.col("r._part") == F.col("p._part")]
    held = pieces.groupBy(*keys, "_part", "_before").agg(F.collect_set("_w").alias("_ws"))
    rows = counted.alias("r").join(held.alias("p"), reduce(lambda a, b: a & b, same)).select(
        *[F.col(f"r.{k}").alias(k) for k in keys], F.col("r._part").alias("_part"), "_v", "_n", "_before", "_ws")
    inside = Window.partitionBy(*keys, "_part").orderBy(F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_to", F.col("_before") + F.sum("_n").over(inside)).withColumn("_w", F.explode("_ws"))

    def holds(rank: Column) -> Column:
        return (rank >= F.col("_to") - F.col("_n")) & (rank < F.col("_to"))

    ends = rows.groupBy(*keys, F.col("_w.name").alias("_name"), F.col("_w.at").alias("_at")).agg(
        F.max(F.when(holds(F.floor("_w.at")), F.col("_v"))).alias("_a"),
        F.max(F.when(holds(F.ceil("_w.at")), F.col("_v"))).alias("_b"))
    share = F.col("_at") - F.floor("_at")
    found = ends.withColumn("_q", F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(
        F.col("_a") * (1 - share) + F.col("_b") * share))
    picked = [F.max(F.when(F.col("_name") == n, F.col("_q"))).alias(n) for n in probabilities]
    lone = df.groupBy(*keys).agg(F.count(value).alias("_n")).where("_n = 0").select(
        *keys, *[F.lit(None).cast("double").alias(n) for n in probabilities])
    return found.groupBy(*keys).agg(*picked).unionByName(lone)
