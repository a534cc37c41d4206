"""Documents whose sets of word n-grams have a Jaccard similarity of at least ``PERCENT`` / 100, by T-occurrence search.

All n-grams stand in one order: by hash, with the frequent ones of a small sample last. If two sets of n and m n-grams
share T = ceil(PERCENT (n + m) / (100 + PERCENT)), then their first n - T + l and m - T + l n-grams share at least l.
So every set offers its first n - ceil(PERCENT n / 100) + l(n), l growing with n, and a partner must occur at least
T' = l(ceil(PERCENT n / 100)) times in the inverted lists of what a set offers (``PERCENT`` and the sizes give T').

DivideSkip: of these lists up to T' - 1 long ones (over ``LONG`` sets) are skipped. The short ones are merged with a
heap; sets that occur T' - (lists skipped) times are candidates. The skipped lists, and all n-grams not offered, are then
probed by binary search in the candidate's sorted set, which gives the exact overlap.

Crowds, sets with T' long lists or more, are linked first to the most shared set of their lists. Where all
sets of a list are linked to each other by then the list goes. In what is left every set outside the largest linked
group of a long list meets the sets of other groups there, unless the n-grams that both could share only in short lists
leave too few: pairs that share one of those are merged anyway. Only
links between different linked groups matter for the components, so no pairs within a group of copies are formed,
and none is lost.

The join works on distinct sets, so copies cost a row each. The sample fixes the order only, not the result. Null and
empty texts and texts of blanks have an empty set and are linked with nothing. Repeated rows keep a row each. A null
doc_id gets a row, but names a component only where no document of it has an id. Other columns are not read. Texts
are read whole, one in memory at a time. No documents: no rows. N-grams and sets are told apart by 64 bits.
"""

from __future__ import annotations

import heapq
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silverbrook.llm.common import WordHashes, components, materialize, mix, rows_of

WIDTH = 4
PERCENT = 85
LONG = 64
STEP = 32
EXTRA = 3
SIZE_CLASS = 0.08
SAMPLE = 10_000
FREQUENT = 20_000
BROADCAST = 1_000_000


def shingles(text: str | None, hashes: WordHashes, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct hashes of a text's n-grams; of all its words if they are fewer."""
    tokens = text.encode().lower().split() if text else []
    if not tokens:
        return np.empty(0, np.uint64)
    h, n = hashes.of(tokens), min(width, len(tokens))
    out = h[:len(h) - n + 1] ^ np.uint64(n)
    for i in range(1, n):
        out = mix(out, h[i:len(h) - n + 1 + i])
    return np.unique(out)


def least_size(n):
    """The fewest n-grams of a partner of a set of ``n``; also the least overlap."""
    return -(-PERCENT * n // 100)


def offered(n):
    """How many n-grams a set of ``n`` offers."""
    return n - least_size(n) + np.minimum(least_size(n), EXTRA + n // STEP)


def _least(n: str) -> str:
    return f"(({PERCENT} * {n} + 99) div 100)"


def _times(n: str) -> str:
    """l(n) of the module's description."""
    return f"least({_least(n)}, {EXTRA} + {n} div {STEP})"


def _overlap(n: str, m: str) -> str:
    return f"(({PERCENT} * ({n} + {m}) + {99 + PERCENT}) div {100 + PERCENT})"


def _alike(n: str, m: str) -> Column:
    """Whether the sizes allow a link."""
    return F.expr(f"least({n}, {m}) >= {_least(f'greatest({n}, {m})')}")


def frequent(docs: DataFrame) -> np.ndarray:
    """The most frequent n-grams of about ``SAMPLE`` documents, at most ``FREQUENT``, rarest first."""
    total = max(1, docs.count())
    part = docs.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE / total)))

    def explode(batches):
        hashes = WordHashes()
        for batch in batches:
            sets = [shingles(t, hashes) for (t,) in rows_of([batch], "text")]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64))],
                                             ["token"])

    rows = part.select("text").distinct().mapInArrow(explode, "token long").groupBy("token").count().where("count > 2")
    best = rows.orderBy(F.desc("count"), "token").limit(FREQUENT).collect()
    return np.array([r.token for r in reversed(best)], np.int64).view(np.uint64)


def members(docs: DataFrame, last: np.ndarray) -> DataFrame:
    """Rows (doc_id, n, sid, n_light, offer) of ``docs``: set size, set, its n-grams not in ``last``, what it offers."""
    by_hash = np.argsort(last)
    known = last[by_hash]

    def make(batches):
        hashes = WordHashes()
        for batch in batches:
            n, sid, light, offers = [], [], [], []
            for (text,) in rows_of([batch], "text"):
                own = shingles(text, hashes)
                at = np.minimum(np.searchsorted(known, own), max(0, len(known) - 1))
                late = known[at] == own if len(known) else np.zeros(len(own), bool)
                most = int(offered(len(own)))
                offer = own[~late][:most]
                light.append(int((~late).sum()))
                if len(offer) < most:
                    offer = np.concatenate([offer, last[np.sort(by_hash[at[late]])][:most - len(offer)]])
                n.append(len(own))
                sid.append(xxhash.xxh64_intdigest(own.tobytes(), 7) - (1 << 63) if len(own) else None)
                offers.append(offer.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(sid, pa.int64()), pa.array(light, pa.int64()),
                 pa.array(offers, pa.binary())], ["doc_id", "n", "sid", "n_light", "offer"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        make, "doc_id long, n long, sid long, n_light long, offer binary")


def entries(classes: DataFrame) -> DataFrame:
    """Rows (token, sid, light): the inverted lists of what the sets offer."""
    def explode(batches):
        for batch in batches:
            sid, light = batch.column("sid").to_numpy(), batch.column("n_light").to_numpy()
            for at in range(0, len(sid), 512):
                own = [np.frombuffer(b, np.int64) for b in batch.column("offer").slice(at, 512).to_pylist()]
                size = [len(x) for x in own]
                place = np.concatenate([np.arange(s) for s in size])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(own)), pa.array(np.repeat(sid[at:at + 512], size)),
                     pa.array(place < np.repeat(light[at:at + 512], size))], ["token", "sid", "light"])

    return classes.select("sid", "n_light", "offer").mapInArrow(explode, "token long, sid long, light boolean")


def sets_of(docs: DataFrame, live: DataFrame) -> DataFrame:
    """Rows (sid, own): the sorted sets of the documents ``live`` (sid, low = doc_id)."""
    ids = live.select(F.col("low").alias("id")).distinct()
    if live.count() <= BROADCAST:  # some ten MB at most; beyond, both sides are shuffled
        ids = F.broadcast(ids)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    docs = docs.join(ids, docs.doc_id.eqNullSafe(ids.id), "left_semi").select("text")

    def make(batches):
        hashes = WordHashes()
        for batch in batches:
            own = [shingles(t, hashes) for (t,) in rows_of([batch], "text")]
            own = [x for x in own if len(x)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([xxhash.xxh64_intdigest(x.tobytes(), 7) - (1 << 63) for x in own], pa.int64()),
                 pa.array([x.tobytes() for x in own], pa.binary())], ["sid", "own"])

    return docs.mapInArrow(make, "sid long, own binary").groupBy("sid").agg(F.first("own").alias("own"))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose exact overlap, found by binary search in the larger set, is enough."""
    both = pairs.join(sets.toDF("u", "own_u"), "u").join(sets.toDF("v", "own_v"), "v").select("u", "v", "own_u", "own_v")

    def probe(batches):
        for batch in batches:
            keep = []
            for a, b in rows_of([batch], "own_u", "own_v"):
                a, b = sorted((np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)), key=len)
                shared = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
                keep.append(100 * shared >= PERCENT * (len(a) + len(b) - shared))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(probe, "u long, v long")


def merged(lists: DataFrame) -> DataFrame:
    """Candidates (u, v) from rows (sid, need, others: sorted): those that ``need`` of a set's short lists hold."""
    rows = lists.repartition("sid").sortWithinPartitions("sid")

    def found(sid, need, own):
        merge = heapq.merge(*own) if len(own) > 1 else own[0]
        return [(sid, other) for other, run in groupby(merge) if sum(1 for _ in run) >= need]

    def merge(batches):
        at, own, wanted = None, [], 1
        for batch in batches:
            out = []
            for sid, need, others in rows_of([batch], "sid", "need", "others"):
                if sid != at:
                    if own:
                        out += found(at, wanted, own)
                    at, own, wanted = sid, [], need
                own.append(others)
            yield _pairs(out)
        if own:
            yield _pairs(found(at, wanted, own))

    return rows.mapInArrow(merge, "u long, v long")


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], pa.int64()) for i in range(2)], ["u", "v"])


def links(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges (u, v) between sets whose components are those of all pairs at the similarity."""
    index = entries(classes)
    often = index.groupBy("token").count().where("count > 1").select("token")
    shared = materialize(index.join(often, "token"), "shared")
    live = shared.groupBy("sid").agg(F.count("*").alias("s")).join(classes.drop("offer"), "sid").withColumn("offers", F.expr(
        f"n - {_least('n')} + {_times('n')}")).withColumn("r", F.expr(_times(_least("n"))))
    live = materialize(live.where("s >= r").select(
        "sid", "low", "n", "r", F.expr("s * 1000 div offers").alias("share"),
        (F.col("n_light") <= F.col("offers")).alias("deep"), (F.col("n") - F.col("n_light")).alias("late")), "live")
    sets = materialize(sets_of(docs, live.select("sid", "low")), "sets")

    rows = shared.join(live.select("sid", "n", "share", "r", F.floor(F.log("n") / SIZE_CLASS).alias("size")), "sid")
    score = F.col("share") * (1 << 40) + F.col("sid").bitwiseAND((1 << 40) - 1)
    centres = rows.groupBy("token", "size").agg(F.max_by("sid", score).alias("centre"), F.max(score).alias("score"))
    reach = rows.select("token", "sid", "r", score.alias("own"), F.explode(F.array(
        F.col("size") - 1, "size", F.col("size") + 1)).alias("size"))
    near = reach.join(centres, ["token", "size"]).where("score > own").groupBy("sid", "centre").agg(
        F.count("*").alias("times"), F.max("r").alias("r"), F.max("score").alias("score")).where("times >= r")
    best = near.groupBy("sid").agg(F.max_by("centre", "score").alias("a"), F.max_by(
        "centre", F.col("times") * 2000 + F.shiftright("score", 40)).alias("b"))
    near = best.select(F.col("sid").alias("u"), F.explode(F.array_distinct(F.array("a", "b"))).alias("v"))
    first = materialize(verified(near, sets), "first-links")
    to = first.join(live.select(F.col("sid").alias("v"), "share"), "v").groupBy(F.col("u").alias("sid")).agg(
        F.max_by("v", F.col("share") * (1 << 40) + F.col("v").bitwiseAND((1 << 40) - 1)).alias("to"))
    label = live.join(to, "sid", "left").select("*", F.coalesce("to", "sid").alias("near")).drop("to")
    hop = label.select(F.col("sid").alias("near"), F.col("near").alias("label"))
    live = materialize(label.join(hop, "near").drop("near"), "labelled")

    rows = shared.join(live.select("sid", "label"), "sid")
    mixed = rows.groupBy("token").agg(F.count("*").alias("df"), F.min("label").alias("a"), F.max("label").alias("b"))
    rows = rows.drop("label").join(mixed.where("a <> b").select("token", "df"), "token")
    rows = materialize(rows, "mixed")
    need = rows.groupBy("sid").agg(
        F.count("*").alias("s"), F.count_if(F.col("df") > LONG).alias("n_long"),
        F.count_if((F.col("df") > LONG) & F.col("light")).alias("light_long"))
    need = need.join(live, "sid").where("s >= r").select(
        "sid", "n", "label", "deep", (F.col("late") + F.col("light_long")).alias("most"), F.greatest(F.lit(1), F.col("r") - F.col("n_long")).alias("need"),
        (F.col("n_long") >= F.col("r")).alias("crowd"))
    rows = materialize(rows.join(need, "sid"), "needs")

    lists = rows.where(F.col("df") <= LONG).groupBy("token").agg(
        F.sort_array(F.collect_list(F.struct("sid", "n", "label", "need", "crowd"))).alias("members"))
    lists = lists.select("members", F.explode("members").alias("me"))
    me = F.col("me")
    others = F.filter("members", lambda y: (y["label"] != me["label"]) & (y["crowd"] | (y["sid"] < me["sid"])) & (
        F.least(y["n"], me["n"]) * 100 >= PERCENT * F.greatest(y["n"], me["n"])))
    lists = lists.select("me.sid", "me.need", F.transform(others, lambda y: y["sid"]).alias("others")).where(
        F.size("others") > 0)

    crowd = rows.where("crowd").where(F.col("df") > LONG).select("token", "sid", "n", "label", "deep", "most")
    largest = crowd.groupBy("token", "label").count().groupBy("token").agg(F.max_by("label", "count").alias("largest"))
    few = crowd.join(largest, "token").where("label <> largest").select(
        "token", F.col("sid").alias("u"), F.col("n").alias("m"), F.col("label").alias("other"),
        F.col("deep").alias("u_deep"), F.col("most").alias("u_most"))
    meet = crowd.join(few, "token").where(
        (F.col("label") != F.col("other")) & _alike("n", "m") & ~(F.col("deep") & F.col("u_deep") & F.expr(
            f"least(most, u_most) < {_overlap('n', 'm')}"))).select("u", F.col("sid").alias("v"))
    pairs = merged(lists).union(meet).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    return first.union(verified(pairs, sets))


def jaccard_classes(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id): set size and smallest doc_id reachable by links, for every row."""
    all_members = materialize(members(docs, frequent(docs)), "members")
    classes = materialize(all_members.where("sid IS NOT NULL").groupBy("sid").agg(
        F.min("doc_id").alias("low"), F.first("n").alias("n"), F.first("n_light").alias("n_light"),
        F.first("offer").alias("offer")), "classes")
    parts = components(links(docs, classes))
    groups = classes.select("sid", "low").join(parts, F.col("sid") == F.col("node"), "left").select(
        "sid", "low", F.coalesce("component", "sid").alias("component"))
    lowest = groups.groupBy("component").agg(F.min("low").alias("component_id"))
    groups = groups.join(lowest, "component").select("sid", "component_id")
    return all_members.join(groups, "sid", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
