"""Prefix trie of rebuilt conversations, built by van Emde Boas recursion.

A conversation is a sequence of turns; every distinct prefix is a node. The sequences are cut at half depth, the
halves again at their half depth and so on down to blocks of ``BLOCK`` turns. Upper halves that end at a cut get a
name from the names of their own halves, so naming takes one round per level, with half the rows each time. A block
belongs to the forest named by the upper halves of the cuts above it; those names are all known by then, so the
blocks of the upper trie and of all lower forests are built side by side, in one grouping. Totals go the other way:
a lower half's total is grafted on the upper half of the same cut.

Totals are carried by conversations: each node is charged to its smallest member, which is also the smallest member
of the nodes below on its own path. What lies below a node is then the sum of what its members are charged with below
it, so no pairs of ancestor and descendant are formed. Work grows with turns times the logarithm of the longest
conversation. No conversation and no node is gathered in one place: only blocks of ``BLOCK`` turns and chunks of
``CHUNK`` conversation ids are.

Rows without a conv_id take no part. Turns are ordered by turn (null first), then role, then text; repeated rows are
turns of their own. Null role and text count as empty. Other columns are ignored, whatever their names. No rows: no
nodes. Turns and prefixes are told apart by 128 bits of SHA-256.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silverbrook.llm.common import materialize

BLOCK = 8
CHUNK = 4096
FAMILY = 20
WORD = r"[^\x20\x09-\x0D]+"


def _name(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 32)


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, pos from 1, token, words), ordered by a range sort, so a huge conversation spans many tasks."""
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "conv_id", F.monotonically_increasing_id().alias("at"),
        _name(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")).alias("token"),
        F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))
    rows = materialize(rows, "turns").withColumn("part", F.shiftright("at", 33))
    runs = rows.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("conv_id", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return rows.join(runs, ["conv_id", "part"]).select(
        "conv_id", (F.col("at") - F.col("first") + F.col("before") + 1).alias("pos"), "token", "words")


def rebuild(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) after each took the first turns of its family's first conversation."""
    turns = materialize(turns, "numbered")
    size = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    family = F.col("conv_id") - F.col("conv_id") % FAMILY
    size = size.select("conv_id", "n", family.alias("base"), (F.crc32(F.col("conv_id").cast("string")) % 4).alias("h"))
    firsts = size.where("conv_id = base").select("base", F.col("n").alias("base_n"))
    convs = size.join(firsts, "base", "left").withColumn("took", F.least("h", F.coalesce("base_n", F.lit(0)))).select(
        "conv_id", "base", "h", "took", (F.col("took") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len"))
    convs = materialize(convs, "conversations")
    heads = turns.where((F.col("conv_id") == family) & (F.col("pos") <= 3)).withColumnRenamed("conv_id", "base")
    taken = heads.join(convs, "base").where("pos <= h").select("conv_id", "pos", "token", "words")
    own = turns.join(convs, "conv_id").where("pos > h").select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("took")).alias("pos"), "token", "words")
    return taken.unionByName(own), convs.select("conv_id", "len")


def _bits(value: str, levels: int, bit: int) -> Column:
    """The levels at which ``value`` lies in the lower (bit 1) or upper (bit 0) half of a cut."""
    return F.filter(F.sequence(F.lit(0), F.lit(levels - 1)),
                    lambda j: F.getbit(F.col(value), j) == bit)


def _half(value: str, level: str) -> Column:
    return F.call_function("shiftright", F.col(value), F.col(level))


def name_forests(blocks: DataFrame, levels: int) -> DataFrame:
    """Rows (conv_id, q, forest): the name of everything before block ``q``, for q > 0."""
    level = blocks.where(F.size("turns") == BLOCK).select(
        "conv_id", F.col("q").alias("idx"), _name(F.array_join(F.col("turns.token"), "")).alias("name"))
    named = None
    for j in range(levels):
        level = materialize(level, f"halves-{j}")
        upper = level.where("idx % 2 = 0").withColumn("level", F.lit(j))
        named = upper if named is None else named.unionByName(upper)
        lower = level.where("idx % 2 = 1").select("conv_id", (F.col("idx") - 1).alias("idx"), F.col("name").alias("low"))
        level = level.join(lower, ["conv_id", "idx"]).select(
            "conv_id", F.shiftright("idx", 1).alias("idx"), _name(F.concat("name", "low")).alias("name"))
    cuts = blocks.where("q > 0").select("conv_id", "q", F.explode(_bits("q", levels, 1)).alias("level"))
    cuts = cuts.withColumn("idx", _half("q", "level") - 1)
    above = cuts.join(named, ["conv_id", "level", "idx"]).groupBy("conv_id", "q").agg(
        F.sort_array(F.collect_list(F.struct("level", "name")), asc=False).alias("cuts"))
    return above.select("conv_id", "q", _name(F.array_join(F.col("cuts.name"), "")).alias("forest"))


def graft(blocks: DataFrame, levels: int) -> DataFrame:
    """``blocks`` (conv_id, q, total, ...) with ``below``: the totals of the conversation's later blocks."""
    lower = blocks.where("q > 0").select("conv_id", "total", "q", F.explode(_bits("q", levels, 1)).alias("level"))
    lower = lower.groupBy("conv_id", "level", _half("q", "level").alias("idx")).agg(F.sum("total").alias("low"))
    upper = blocks.select("conv_id", "q", F.explode(_bits("q", levels, 0)).alias("level"))
    found = upper.withColumn("idx", _half("q", "level") + 1).join(lower, ["conv_id", "level", "idx"]).groupBy(
        "conv_id", "q").agg(F.sum("low").alias("below"))
    return blocks.join(found, ["conv_id", "q"], "left").withColumn("below", F.coalesce("below", F.lit(0)))


def _levels(blocks: DataFrame) -> int:
    return int(blocks.agg(F.max("q")).first()[0] or 0).bit_length()


def paths(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Rows (conv_id, len, depth, key, words): one for every conversation and depth, the root included."""
    blocks = materialize(turns.groupBy("conv_id", F.expr(f"(pos - 1) div {BLOCK}").alias("q")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "token", "words"))).alias("turns")), "blocks")
    levels = _levels(blocks)
    if levels:
        blocks = blocks.join(name_forests(blocks, levels), ["conv_id", "q"], "left")
    else:
        blocks = blocks.withColumn("forest", F.lit(""))
    tokens = F.array_join(F.slice(F.col("turns.token"), F.lit(1), F.col("i")), "")
    nodes = blocks.withColumn("forest", F.coalesce("forest", F.lit(""))).select(
        "conv_id", "forest", "turns", F.posexplode("turns").alias("i", "turn")).withColumn("i", F.col("i") + 1).select(
        "conv_id", F.col("turn.pos").alias("depth"), _name(F.concat("forest", F.lit("/"), tokens)).alias("key"),
        F.col("turn.words").alias("words"))
    nodes = nodes.join(convs, "conv_id")
    root = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit("").alias("key"),
                        F.lit(0).cast("long").alias("words"), "len")
    return nodes.unionByName(root)


def digests(members: DataFrame) -> DataFrame:
    """Rows (key, depth, ends_sha256) of ``members`` (key, depth, conv_id): their sorted ids, read in chunks."""
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    chunks = members.groupBy("key", "depth", F.expr(f"conv_id div {CHUNK}").alias("chunk")).agg(ids.alias("ids"))
    chunks = chunks.repartition("key", "depth").sortWithinPartitions("key", "depth", "chunk")

    def hashed(batches):
        at, state, out = None, None, []
        for batch in batches:
            for *node, ids in zip(*(batch.column(n).to_pylist() for n in ("key", "depth", "ids")), strict=True):
                if node == at:
                    state.update(b",")
                else:
                    if at is not None:
                        out.append((*at, state.hexdigest()))
                    at, state = node, hashlib.sha256()
                state.update(ids.encode())
            yield _rows(out)
            out = []
        if at is not None:
            yield _rows([(*at, state.hexdigest())])

    return chunks.mapInArrow(hashed, "key string, depth long, ends_sha256 string")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))],
        ["key", "depth", "ends_sha256"])


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """Every node of the trie of the rebuilt conversations.

    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (over the
    subtree, words of a node's last text for each member but one), ends_sha256 (ids of the members that end there).
    """
    turns, convs = rebuild(numbered_turns(conversations))
    path = materialize(paths(turns, convs), "paths")
    nodes = path.groupBy("key", "depth").agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("words").alias("words"),
        F.max("len").alias("deepest"))
    nodes = materialize(nodes.withColumn("charge", (F.col("n_convs") - 1) * F.col("words")), "nodes")

    heads = nodes.groupBy("conv_id").agg(
        F.min("depth").alias("top"), F.sum("charge").alias("charged"),
        F.max((F.col("deepest") == F.col("depth")).cast("long")).alias("leaf"))
    blocks = materialize(nodes.groupBy("conv_id", F.expr(f"depth div {BLOCK}").alias("q")).agg(
        F.sort_array(F.collect_list(F.struct("depth", "charge"))).alias("own"), F.sum("charge").alias("total")), "own")
    levels = _levels(blocks)
    blocks = graft(blocks, levels) if levels else blocks.withColumn("below", F.lit(0))
    rest = F.aggregate(F.slice(F.col("own.charge"), F.col("i") + 1, F.lit(BLOCK)), F.col("below").cast("long"),
                       lambda a, x: a + x)
    own = blocks.select("conv_id", "own", "below", F.posexplode("own").alias("i", "node")).select(
        "conv_id", F.col("node.depth").alias("depth"), rest.alias("own_tokens"))

    member = path.join(heads, "conv_id", "left").select(
        "key", "depth", "conv_id", "top",
        F.when(F.col("depth") < F.col("top"), F.col("charged")).otherwise(0).alias("charged"),
        F.coalesce("leaf", F.lit(0)).alias("leaf"),
        F.coalesce((F.col("top") == F.col("depth") + 1) | ((F.col("top") <= F.col("depth")) &
                   (F.col("len") > F.col("depth"))), F.lit(False)).cast("long").alias("child"))
    sums = member.groupBy("key", "depth").agg(
        F.sum("charged").alias("other_tokens"), F.sum("leaf").alias("n_leaves"), F.sum("child").alias("n_children"))
    above = member.where("top = depth + 1").select("key", "depth", F.col("conv_id").alias("child_id")).join(
        nodes.select("key", "depth", F.col("conv_id").alias("above_id")), ["key", "depth"]).select(
        F.col("child_id").alias("conv_id"), (F.col("depth") + 1).alias("depth"), "above_id")
    ends = digests(path.where("depth = len").select("key", "depth", "conv_id"))

    tree = nodes.join(sums, ["key", "depth"]).join(ends, ["key", "depth"], "left")
    tree = tree.join(own, ["conv_id", "depth"]).join(above, ["conv_id", "depth"], "left")
    return tree.select(
        "conv_id", "depth",
        F.when(F.col("depth") > 0, F.coalesce("above_id", "conv_id")).alias("parent_conv_id"), "n_convs", "n_children",
        "n_leaves", (F.col("own_tokens") + F.col("other_tokens")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
