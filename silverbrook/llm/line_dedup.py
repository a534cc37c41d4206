"""Fuzzy line deduplication in DataFrame functions only.

Lines are normalised: lower case, everything but letters and digits becomes one blank. Two lines are linked if the
edit similarity of their word sequences is ``SIMILARITY`` or more. Of every connected group the first occurrence
stays, by doc_id and line number; equal normalised lines are one line.

Blocks. A segment is a run of neighbouring words and has the SimHash of its words: 64 bits, each set if more than
half of the words' hashes set it. ``e`` edits leave at most ``e + 1`` unbroken runs, so by the pigeonhole principle
similar lines share a run of three words, from 20 words on one of four; lines of four to six words also offer
pairs. A line offers the segments with the smallest fingerprints: ``SHORT`` of three words, from ``LONG`` words on
``MANY`` of four, and half of that of each from ``BETWEEN`` words on, so that lines of either kind meet. Lines up to 8
words offer all and lose no similar pair; of longer ones a pair is missed only if none of the segments offered is
common. There is no limit on differing bits of a line: lines that meet are compared by edit distance,
unless their lengths or the parities of their words rule it out. README has the recall measured.

Crowds. Keys seen in one line only are dropped before rows are carried. The lines of a key are dealt into ``HEADS``
lanes and each line meets the smallest line of every lane. Where more lines share a key, all lines of one connected
group need no further links. Keys that still hold several groups are dealt by the lengths of their lines, and where ``HEADS`` squared
lines or fewer are left together, lines of different groups all meet. The others meet by pairs of neighbouring words:
an edit takes two of them from a line, so similar lines share one of their ``2 e + 1`` rarest, counted in buckets among these
lines; a pair that a line repeats counts as a first, a second one and so on. They meet by lanes again, and where a pair still holds several groups, lines outside its largest group meet
all lines of other groups there. So a link between lines that offer a common segment is never lost to a crowd.

For the comparison a word is one of 2^20 symbols, so that edit distance counts words and long lines stay cheap;
equality of lines goes by a 64-bit hash of the whole normalised line.

Null texts have no lines and stay null. Blank lines and lines without letters or digits are kept. Documents
without an id stay as they are. Repeated rows have the same occurrences, which stay or go together. Very long lines
offer as many segments as other long ones; their edit distance is computed within the edits allowed. No documents give no
rows. Other columns, whatever their names, are kept; ``n_lines`` and ``n_removed`` replace columns of these names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silverbrook.llm.common import components, materialize

SIMILARITY = 0.8
SHORT, MANY = 6, 8
BETWEEN, LONG = 30, 38  # similar lines under and over this range differ by more words than it has
HEADS = 16
KEYS = 32  # of a line that are carried to meet each other line once; lines of more meet under each of them
BUCKETS = 1 << 18  # that count how rare word pairs are; pairs of one bucket count as equally rare
_SYMBOL_BITS, _SYMBOL = 0x03FF03FF, 0xD800DC00  # twenty bits of a hash as one UTF-16 surrogate pair


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), r"[^a-z0-9\p{L}\p{N}]+", " "))


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, norm) of every line with a letter or digit, of documents with an id."""
    # Normalised before they become rows: a condition on a computed column would compute it twice.
    return docs.where("doc_id IS NOT NULL").select(
        "doc_id", F.posexplode(F.transform(F.split("text", "\n", -1), normalised)).alias("line_no", "norm")).where("norm <> ''")


def _segments(h: str) -> Column:
    """The SimHashes offered by a line whose words have the hashes ``h``."""
    n = F.size(h)

    def runs(width: int, simhash) -> Column:
        return F.transform(F.slice(h, 1, F.greatest(n - width + 1, F.lit(0))), simhash)

    def two(x: Column, i: Column) -> Column:
        return x.bitwiseAND(F.get(h, i + 1))

    def three(x: Column, i: Column) -> Column:
        y, z = F.get(h, i + 1), F.get(h, i + 2)
        return x.bitwiseAND(y.bitwiseOR(z)).bitwiseOR(y.bitwiseAND(z))

    def four(x: Column, i: Column) -> Column:
        y, z, last = F.get(h, i + 1), F.get(h, i + 2), F.get(h, i + 3)
        return x.bitwiseAND(y).bitwiseAND(z.bitwiseOR(last)).bitwiseOR(z.bitwiseAND(last).bitwiseAND(x.bitwiseOR(y)))

    def smallest(values: Column, m: int) -> Column:
        return F.slice(F.array_distinct(F.slice(F.sort_array(values), 1, 4 * m)), 1, m)

    return F.when(n >= LONG, smallest(runs(4, four), MANY)).when(
        n >= BETWEEN, F.concat(smallest(runs(3, three), MANY // 2), smallest(runs(4, four), MANY // 2))).when(
        n > 6, smallest(runs(3, three), SHORT)).when(
        n > 3, F.array_distinct(F.concat(runs(3, three), runs(2, two)))).otherwise(F.array().cast("array<bigint>"))


def _toggled(bits: Column, x: Column) -> Column:
    """``bits`` with the one flipped that the last six bits of ``x`` name."""
    return bits.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int")))


def described(lines_of: DataFrame) -> DataFrame:
    """The rows with ``words`` (how many), ``segments`` and ``sketch``.

    A sketch has 64 parities, each of the number of words that fall to it. One edit changes two of them at most.
    """
    rest = lines_of.columns
    hashed = lines_of.select(*rest, F.transform(F.split("norm", " "), lambda w: F.xxhash64(w)).alias("h"))
    return hashed.select(*rest, F.size("h").alias("words"), _segments("h").alias("segments"),
                         F.aggregate("h", F.lit(0).cast("long"), _toggled).alias("sketch"))


def symbols(norm: Column) -> Column:
    """The words of a normalised line, one character each."""
    code = F.transform(F.split(norm, " "), lambda w: F.hex(
        F.xxhash64(w).bitwiseAND(F.lit(_SYMBOL_BITS)).bitwiseOR(F.lit(_SYMBOL))))
    return F.decode(F.unhex(F.array_join(code, "")), "UTF-16BE")


def _edits(longest: Column) -> Column:
    return F.floor(longest * (1 - SIMILARITY) + 1e-9).cast("int")


def _near() -> Column:
    """Whether words and sketches of two lines, the second with a v, allow for similar lines."""
    more = F.abs(F.col("words") - F.col("wordsv"))
    edits = _edits(F.greatest("words", "wordsv"))
    return (more <= edits) & (F.bit_count(F.col("sketch").bitwiseXOR(F.col("sketchv"))) <= _parities())


def _parities() -> Column:
    """The most parities in which two similar lines differ.

    A word replaced changes two, a word more or less one; each word that one line is longer takes an edit of the second kind.
    """
    return 2 * _edits(F.greatest("words", "wordsv")) - F.abs(F.col("words") - F.col("wordsv"))


def _verified(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs (u, v) of lines (k, symbols) whose word sequences are similar enough."""
    a = known.select(F.col("k").alias("u"), F.col("symbols").alias("su"))
    b = known.select(F.col("k").alias("v"), F.col("symbols").alias("sv"))
    allowed = _edits(F.greatest(F.length("su"), F.length("sv")))
    return pairs.join(a, "u").join(b, "v").where(
        F.call_function("levenshtein", F.col("su"), F.col("sv"), allowed) >= 0).select("u", "v")


def _meetings(keyed: DataFrame, heads: int) -> tuple[DataFrame, DataFrame]:
    """From distinct rows (key, k, words, sketch): pairs (u, v) that may be similar, and the keys not all of whose pairs met.

    With a column component, lines of one component need not meet.
    """
    apart = "component" if "component" in keyed.columns else "k"
    lane = F.pmod(F.xxhash64("k", F.lit(heads)), F.lit(heads))
    first = keyed.groupBy("key", lane.alias("lane")).agg(
        F.min("k").alias("v"), F.min_by("words", "k").alias("wordsv"), F.min_by("sketch", "k").alias("sketchv"),
        F.min_by(apart, "k").alias("other"), F.count("*").alias("n"))
    pairs = keyed.join(first.select("key", "v", "wordsv", "sketchv", "other"), "key").where(
        (F.col(apart) != F.col("other")) & _near()).select(F.greatest("k", "v").alias("u"), F.least("k", "v").alias("v"))
    crowded = first.groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("lanes")).where("n > lanes + 1")
    return pairs.distinct(), crowded.select("key")


def _open(keyed: DataFrame, crowded: DataFrame, group: DataFrame) -> DataFrame:
    """The rows of crowded keys that hold more than one component, with it."""
    rows = keyed.join(crowded, "key", "left_semi")
    member = rows.drop("component").join(group, F.col("k") == F.col("node"), "left").select(
        "key", "k", "words", "sketch", F.coalesce("component", "k").alias("component"))
    split = member.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b")
    return member.join(split, "key", "left_semi")


def _lost() -> Column:
    """The most word pairs of a line that edits allowed take away: two each, or one where the other line is longer."""
    fives = F.ceil(F.col("words") / 5)
    return F.greatest(2 * F.floor(F.col("words") / 5), F.col("words") - 3 * fives)


def _rarest(lone: DataFrame, known: DataFrame) -> DataFrame:
    """Rows (key, k, words, sketch, component), the keys one more of a line's rarest word pairs than edits take away; similar lines share one.

    A pair that a line has several times is a first, a second one and so on, and these are keys of their own. Keys of one component are left out.
    """
    h = F.transform(F.split("symbols", ""), lambda w: F.xxhash64(w))
    pairs = F.zip_with(F.slice("h", 1, F.size("h") - 1), F.slice("h", 2, F.size("h") - 1), lambda x, y: F.xxhash64(x, y))
    # Merged, so that the pairs are where all of their line's are: a broadcast would leave that to a shuffle of pairs.
    texts = lone.where("words > 3").hint("merge").join(known, "k").select("k", "words", "component", h.alias("h"))
    bucket = F.col("pair").bitwiseAND(F.lit(BUCKETS - 1)).alias("bucket")
    often = materialize(texts.select(F.explode(pairs).alias("pair")).groupBy(bucket).agg(F.count("*").alias("n")), "line-often")
    # From the join on, the pairs of a line stay in its task: nothing but the counts, at most BUCKETS rows, is sent to them.
    times = texts.select("k", "words", "component", F.explode(pairs).alias("pair")).groupBy("k", "words", "component", "pair").agg(
        F.count("*").alias("times"))
    every = times.select("k", "words", "component", bucket, "pair", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("time"))
    rarity = Window.partitionBy("k").orderBy(F.col("n") / F.col("time"), "pair", "time")
    first = materialize(every.join(F.broadcast(often), "bucket").withColumn("place", F.row_number().over(rarity)).where(
        F.col("place") <= _lost() + 1).select("k", "component", F.xxhash64("pair", "time").alias("key")), "line-rarest")
    split = first.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b")
    return first.drop("component").join(split, "key", "left_semi").join(lone, "k").select("key", *lone.columns)


def _wide() -> Column:
    """Sketches of 256 parities from the words' hashes ``h``, which still tell long lines apart that have a passage in common."""
    def part(i: int) -> Column:
        some = F.filter("h", lambda x: F.shiftrightunsigned(x, 6).bitwiseAND(F.lit(3)) == i)
        return F.aggregate(some, F.lit(0).cast("long"), _toggled)

    return F.array(*map(part, range(4)))


def _differ() -> Column:
    """In how many of the 256 parities two lines differ, the second with a v."""
    return sum((F.bit_count(F.get("wide", F.lit(i)).bitwiseXOR(F.get("widev", F.lit(i)))) for i in range(4)), F.lit(0))


def _close(open_rows: DataFrame, known: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """From rows (key, k, words, sketch, component): pairs (u, v) that may be similar, and the lines left to meet.

    A key is dealt by the lengths of its lines, each line to its own length and to the next, so similar lines stay together. Up
    to ``most`` lines meet as they are; the rest is left.
    """
    length = F.floor(F.log("words") / math.log(1 / SIMILARITY) + 1e-9)
    dealt = materialize(open_rows.join(known.select("k", "wide"), "k").select("*", F.explode(F.array(length, length + 1)).alias("length")).select(
        F.xxhash64("key", "length").alias("part"), "k", "words", "sketch", "wide", "component"), "line-parts")
    parts = dealt.groupBy("part").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("n")).where("a <> b")
    few = materialize(dealt.join(parts.where(F.col("n") <= most).select("part"), "part", "left_semi"), "line-few")
    others = few.select("part", F.col("k").alias("v"), F.col("words").alias("wordsv"), F.col("sketch").alias("sketchv"),
                        F.col("wide").alias("widev"), F.col("component").alias("other"))
    pairs = few.join(others, "part").where((F.col("k") > F.col("v")) & (F.col("component") != F.col("other")) & _near() & (
        _differ() <= _parities())).select(F.col("k").alias("u"), "v")
    many = dealt.join(parts.where(F.col("n") > most).select("part"), "part", "left_semi")
    return pairs.distinct(), many.select("k", "words", "sketch").distinct()


def _across(left: DataFrame, known: DataFrame) -> DataFrame:
    """From rows (key, k, words, sketch, component): the pairs (u, v) of a key that may be similar and are of two components."""
    # A pair meets once, under the smallest key that its lines share; long lists of keys are not carried, their lines meet under each.
    keys = left.groupBy("k").agg(F.count("*").alias("n"), F.collect_list("key").alias("keys")).select(
        "k", F.when(F.col("n") <= KEYS, F.col("keys")).alias("keys"))
    left = materialize(left.join(keys, "k").join(known.select("k", "wide"), "k"), "line-wide")
    main = left.groupBy("key", "component").agg(F.count("*").alias("n")).groupBy("key").agg(
        F.max_by("component", F.struct("n", "component")).alias("main"))
    outside = left.join(main, "key").where("component <> main").select(
        "key", F.col("k").alias("v"), F.col("words").alias("wordsv"), F.col("sketch").alias("sketchv"),
        F.col("wide").alias("widev"), F.col("keys").alias("keysv"), F.col("component").alias("other"))
    once = F.coalesce(F.array_min(F.array_intersect("keys", "keysv")) == F.col("key"), F.lit(True))
    more = left.join(outside, "key").where((F.col("component") != F.col("other")) & _near() & (_differ() <= _parities()) & once).select(F.greatest("k", "v").alias("u"), F.least("k", "v").alias("v"))
    return more


def links(occurrences: DataFrame, heads: int = HEADS) -> DataFrame:
    """Edges (u, v) between lines that connect what all links found would connect; rows as ``described`` gives them.

    Only lines of shared keys are looked up again.
    """
    keyed = occurrences.select("k", F.explode("segments").alias("key"))
    # Of several lines: a key that only copies of one line have leads nowhere. Rows are carried without their lines.
    twice = materialize(keyed.groupBy("key").agg(F.min("k").alias("a"), F.max("k").alias("b")).where("a <> b").select("key"), "line-twice")
    met = keyed.join(twice, "key", "left_semi").distinct()
    shared = materialize(met.join(occurrences.groupBy("k").agg(F.max("words").alias("words"), F.max("sketch").alias("sketch")), "k").select(
        "key", "k", "words", "sketch"), "line-shared")
    pairs, crowded = _meetings(shared, heads)
    pairs, crowded = materialize(pairs, "line-pairs"), materialize(crowded, "line-crowds")
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("k")).union(
        shared.join(crowded, "key", "left_semi").select("k")).distinct()
    known = materialize(occurrences.select("k", "norm").join(nodes, "k", "left_semi").groupBy("k").agg(
        F.max("norm").alias("norm")).select("k", "norm", F.transform(F.split("norm", " "), lambda w: F.xxhash64(w)).alias("h")).select(
        "k", symbols(F.col("norm")).alias("symbols"), _wide().alias("wide")), "line-known")
    found = materialize(_verified(pairs, known), "line-links")
    pairs, lone = _close(_open(shared, crowded, components(found)), known, heads * heads)
    pairs, lone = materialize(pairs, "line-pairs"), materialize(lone, "line-open")
    found = found.union(materialize(_verified(pairs, known), "line-links"))
    group = components(found)
    lone = lone.join(group, F.col("k") == F.col("node"), "left").select("k", "words", "sketch", F.coalesce("component", "k").alias("component"))
    rare = materialize(_rarest(lone, known), "line-rare")
    pairs, crowded = _meetings(rare, heads)
    pairs, crowded = materialize(pairs, "line-pairs"), materialize(crowded, "line-crowds")
    found = found.union(materialize(_verified(pairs, known), "line-links"))
    left = materialize(_open(rare, crowded, components(found)), "line-left")
    late = materialize(_across(left, known).distinct(), "line-late")
    return found.union(_verified(late, known))


def removed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, gone): the numbers of the lines to remove, for documents that have any."""
    occurrences = materialize(described(lines(docs).select("doc_id", "line_no", F.xxhash64("norm").alias("k"), "norm")), "lines")
    group = components(links(occurrences))
    counted = occurrences.groupBy("k").agg(F.count("*").alias("n"))
    repeated = counted.join(group, counted.k == group.node, "left").where(
        "n > 1 OR component IS NOT NULL").select("k", F.coalesce("component", "k").alias("component"))
    hits = materialize(occurrences.select("doc_id", "line_no", "k").join(repeated, "k").select(
        "component", "doc_id", "line_no"), "line-hits")
    first = hits.groupBy("component").agg(F.min(F.struct("doc_id", "line_no")).alias("first"))
    return hits.join(first, "component").where(F.struct("doc_id", "line_no") > F.col("first")).groupBy("doc_id").agg(
        F.collect_set("line_no").alias("gone"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with text without its repeated lines, and with ``n_lines`` and ``n_removed``."""
    kept = [c for c in docs.columns if c not in ("text", "n_lines", "n_removed")]
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], "text", F.col("doc_id").alias("doc"))
    joined = inner.join(removed_lines(docs.select("doc_id", "text")), F.col("doc") == F.col("doc_id"), "left")
    parts, gone = F.split("text", "\n", -1), F.col("gone")
    rest = F.filter(parts, lambda x, i: ~F.array_contains(gone, i))
    done = joined.select(
        *[f"c{i}" for i in range(len(kept))],
        F.when(gone.isNull(), F.col("text")).otherwise(F.array_join(rest, "\n")).alias("text"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).cast("long").alias("n_lines"),
        F.when(gone.isNull(), 0).otherwise(F.size(gone)).cast("long").alias("n_removed"))
    return done.toDF(*kept, "text", "n_lines", "n_removed")
