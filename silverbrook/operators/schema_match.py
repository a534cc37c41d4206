"""Ranking of incoming files against existing tables by column overlap.

Inputs are exploded columns: ``tenant_id, dataset_id, ordinal, name, type``; tables also
carry ``layer``. Files are compared with the tables of their own tenant.

Joining on column names alone would pair everything that has an ``id`` column. A result
needs a minimum overlap, though, so each side only offers its rarest columns for pairing:
two datasets that share enough columns must share one of those (prefix filtering). Pairs
found this way are then scored on all their columns, so nothing is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silverbrook.functions.coltypes import type_category
from silverbrook.functions.naming import web_name
from silverbrook.operators.ordered import row_numbers
from silverbrook.session import each, materialize, together

# Weights of a matched column, and what makes a match worth showing.
EXACT_WEIGHT, COMPATIBLE_WEIGHT, OTHER_WEIGHT = 1.0, 0.75, 0.5
MIN_SCORE, MIN_MATCHED = 30, 3

# Score bands of the decision.
AUTO_SELECT, HIGH_CONFIDENCE, EXACT_BAND, MEDIUM_BAND = 70, 50, 90, 60


def _keyed(files: DataFrame, tables: DataFrame) -> DataFrame:
    """Columns of both sides with match key and category, computed and stored once.

    The steps below read them several times, and the inputs may be costly views.
    """
    silver = tables.filter(F.coalesce("layer", F.lit("silver")) != "gold")
    columns = ["tenant_id", "dataset_id", "ordinal", "name", "type"]
    both = files.select(*columns, F.lit(True).alias("is_file")).unionByName(
        silver.select(*columns, F.lit(False).alias("is_file")))
    return materialize(
        both.withColumn("key", web_name(F.col("name"))).withColumn("category", type_category(F.col("type"))),
        "match-columns")


def _overlap_needed(n_columns: Column, min_score: int) -> Column:
    """Fewest shared columns with which a dataset of this width can still qualify.

    At the usual limit of 30 one match reaches it up to width 3 and two up to width 6; three always
    qualify. A wider partner only raises the need.
    """
    if min_score < 1:
        raise ValueError("a limit below 1 would pair files with tables that share no column")
    reach = 100 / (min_score - 0.5)
    return F.when(n_columns <= int(reach), 1).when(n_columns <= int(2 * reach), 2).otherwise(MIN_MATCHED)


def _candidate_pairs(columns: DataFrame, min_score: int) -> DataFrame:
    """Distinct file and table pairs that may qualify, with the width of each side."""
    # Repeated keys inside a file can match one table column several times over, so for
    # such a file the count of distinct shared keys proves nothing and all keys are used.
    # Hardly any key repeats within a dataset, so a dataset's rows come together before they are counted.
    whole = ["tenant_id", "is_file", "dataset_id"]
    counted = together(columns, columns.count(), *whole).groupBy(*whole, "key").agg(F.count(F.lit(1)).alias("copies"))
    frequency = counted.groupBy("tenant_id", "key").agg(F.count(F.lit(1)).alias("freq"))
    whole = Window.partitionBy(*whole)
    ranked = counted.join(frequency, ["tenant_id", "key"]).select(
        "tenant_id", "is_file", "dataset_id", "key",
        F.count(F.lit(1)).over(whole).alias("n_keys"),
        F.sum("copies").over(whole).alias("n_columns"),
        F.row_number().over(whole.orderBy("freq", "key")).alias("rarity"))
    rare = F.col("rarity") <= F.col("n_keys") - _overlap_needed(F.col("n_columns"), min_score) + 1
    repeats = F.col("is_file") & (F.col("n_columns") > F.col("n_keys"))
    offered = ranked.select("tenant_id", "is_file", "dataset_id", "key", "n_columns",
                            rare.alias("rare"), repeats.alias("repeats"))

    # Two lanes in one join: ordinary files meet tables on rare keys only, files with
    # repeated keys meet them on every key. A table column travels in each lane it serves.
    file_lane = F.when(F.col("repeats"), F.array(F.lit("any"))).when(F.col("rare"), F.array(F.lit("rare")))
    table_lane = F.when(F.col("rare"), F.array(F.lit("any"), F.lit("rare"))).otherwise(F.array(F.lit("any")))

    def side(is_file: bool, owner: str, width: str) -> DataFrame:
        rows = offered.filter(F.col("is_file") == is_file)
        return each(rows, file_lane if is_file else table_lane, "lane", "tenant_id",
                    F.col("dataset_id").alias(owner), "key", F.col("n_columns").alias(width))

    pairs = side(True, "file_id", "n_inferred").join(
        side(False, "table_id", "n_existing"), ["tenant_id", "key", "lane"])
    return pairs.select("tenant_id", "file_id", "table_id", "n_inferred", "n_existing").distinct()


def _matched(columns: DataFrame, min_score: int) -> DataFrame:
    f = columns.filter("is_file").select(
        "tenant_id", F.col("dataset_id").alias("file_id"), "ordinal", "key", F.col("name").alias("inferred_name"),
        F.col("type").alias("inferred_type"), "category")
    first = together(columns.filter("NOT is_file"), columns.count(), "tenant_id", "dataset_id").groupBy("tenant_id", F.col("dataset_id").alias("table_id"), "key").agg(
        F.min(F.struct("ordinal", "name", "type", "category")).alias("x"))
    partner = first.select(
        "tenant_id", "table_id", "key", F.col("x.name").alias("existing_name"), F.col("x.type").alias("existing_type"),
        F.col("x.category").alias("existing_category"))
    both = _candidate_pairs(columns, min_score).join(f, ["tenant_id", "file_id"]).join(partner, ["tenant_id", "table_id", "key"])
    exact = (F.lower("inferred_type") == F.lower("existing_type")) | (F.col("category") == F.col("existing_category"))
    soft = (F.col("category") == "STRING") | (F.col("existing_category") == "STRING")
    return both.select(
        "tenant_id", "file_id", "table_id", "n_inferred", "n_existing", "ordinal", "inferred_name", "inferred_type",
        "existing_name", "existing_type", exact.alias("exact_type_match"),
        (~exact & soft).alias("compatible_type_match"))


def _scores(matched: DataFrame, min_score: int) -> DataFrame:
    pair = ["tenant_id", "file_id", "table_id", "n_inferred", "n_existing"]
    counts = matched.groupBy(*pair).agg(
        F.count(F.lit(1)).alias("matched"),
        F.count_if("exact_type_match").alias("exact_matches"),
        F.count_if("compatible_type_match").alias("compatible_matches"))
    rest = F.col("matched") - F.col("exact_matches") - F.col("compatible_matches")
    weighted = (F.col("exact_matches") * EXACT_WEIGHT + F.col("compatible_matches") * COMPATIBLE_WEIGHT
                + rest * OTHER_WEIGHT)
    # Halves round up; all weights are multiples of a quarter, so the sum is exact.
    score = F.floor(weighted / F.greatest("n_inferred", "n_existing") * 100 + 0.5)
    return (
        counts.withColumn("score", score.cast("int"))
        .filter((F.col("score") >= min_score) | (F.col("matched") >= MIN_MATCHED))
        .select("tenant_id", "file_id", "table_id", "score", "matched", "exact_matches", "compatible_matches",
                "n_inferred", "n_existing")
    )


def matched_columns(files: DataFrame, tables: DataFrame, min_score: int = MIN_SCORE) -> DataFrame:
    """One row per file column that has a partner in a candidate table.

    The first table column with the key is the partner. Pairs that cannot qualify are
    absent.
    """
    return _matched(_keyed(files, tables), min_score)


def match_scores(files: DataFrame, tables: DataFrame, min_score: int = MIN_SCORE) -> DataFrame:
    """Qualifying (file, table) pairs with their score and match counts.

    A pair qualifies with a score of ``min_score`` (from 1) or three matched columns.
    """
    return _scores(matched_columns(files, tables, min_score), min_score)


def decision(score: Column) -> Column:
    """Band a score falls into."""
    return (F.when(score >= EXACT_BAND, "exact").when(score >= MEDIUM_BAND, "medium").otherwise("low"))


def ranked_matches(files: DataFrame, tables: DataFrame, top: int | None = None,
                   min_score: int = MIN_SCORE) -> DataFrame:
    """Qualifying matches in rank order per file; ties keep table order.

    With ``top`` Spark prunes each file's list before the shuffle; the full ranking is
    spread over the scores, so one file that matches very many tables is not one task.
    """
    scores = match_scores(files, tables, min_score)
    if top is None:
        # The counts behind the numbering read the scores a second time.
        scores = materialize(scores, "match-scores")
        ranked = row_numbers(scores, ["tenant_id", "file_id"], ["score", "exact_matches"], ["table_id"], "rank")
        ranked = ranked.withColumn("rank", F.col("rank").cast("int")).select(*scores.columns, "rank")
    else:
        order = Window.partitionBy("tenant_id", "file_id").orderBy(
            F.desc("score"), F.desc("exact_matches"), F.asc("table_id"))
        ranked = scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    best = F.col("rank") == 1
    return ranked.select(
        "*", decision(F.col("score")).alias("band"),
        (best & (F.col("score") >= AUTO_SELECT)).alias("auto_selected"),
        (best & (F.col("score") >= HIGH_CONFIDENCE)).alias("high_confidence"))


def unmatched_columns(files: DataFrame, tables: DataFrame, min_score: int = MIN_SCORE) -> DataFrame:
    """Columns of qualifying pairs without a partner, one row each, both sides.

    On either side a column counts as matched if a column of that name is matched.
    """
    columns = _keyed(files, tables)
    hits = materialize(_matched(columns, min_score), "match-hits")
    pairs = _scores(hits, min_score).select("tenant_id", "file_id", "table_id")

    def side(is_file: bool, owner: str, hit: str, label: str) -> DataFrame:
        own = columns.filter(F.col("is_file") == is_file).select("tenant_id", F.col("dataset_id").alias(owner), "name")
        seen = hits.select("tenant_id", "file_id", "table_id", F.col(hit).alias("name"))
        return pairs.join(own, ["tenant_id", owner]).join(
            seen, ["tenant_id", "file_id", "table_id", "name"], "left_anti").select(
            "tenant_id", "file_id", "table_id", F.lit(label).alias("side"), "name")

    return side(True, "file_id", "inferred_name", "inferred").unionByName(
        side(False, "table_id", "existing_name", "existing"))
