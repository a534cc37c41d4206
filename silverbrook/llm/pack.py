"""Best-fit packing by a grouping genetic algorithm on islands.

Documents are tokenised in parallel. Pieces of a full sequence are sequences of their own; the rest is dealt by
hash into cells of about ``CELL`` pieces, each a packing problem of bounded size. Every cell is solved on a few
islands, one Spark group each. An individual is a set of bins; crossover copies whole bins, the fullest first, from
one parent into the other, drops the bins of the other that hold a copied piece again, and puts the displaced
pieces back by best fit, largest first. After each epoch the elite of an island moves to the next island of its
cell, through a shuffle; the best individual of a cell is its result. Bins that stay badly filled are dealt out
anew and packed once more across cells.

Nulls are empty texts, which give the closing id alone. Repeated rows are packed as often as they occur. No
documents give no pieces. A null doc_id is packed like any other.
"""

from __future__ import annotations

import random
import struct
import zlib
from functools import lru_cache
from itertools import filterfalse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silverbrook.llm.common import materialize, rows_of

LENGTH = 2048
END = 0  # id that closes a document
CELL = 3_000  # pieces per packing problem, about
ISLANDS, EPOCHS, GENERATIONS, POPULATION = 2, 2, 4, 5
FULL = 0.985  # bins below this share are packed once more across cells


def tokenizer_words(text: str | None) -> list[bytes]:
    """A text cut at blanks and line ends, where the tokenizer cuts too and leaves nothing.

    It lower-cases as well, so ASCII letters are lower-cased here and fewer different words are left, unless a
    combining accent might make one letter of two, or a special token, which is matched before, one of other text.
    """
    data = (text or "").encode()
    if b"<|" not in data and b"\xcc" not in data and b"\xcd" not in data:  # lead bytes of U+0300 to U+036F and some more
        data = data.lower()
    return data.replace(b"\n", b" ").split(b" ")


def _byte_letters() -> dict[int, int]:
    """How a byte-level vocabulary spells bytes: printable ones as themselves, the rest from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in printable]
    return {b: 0x100 + i for i, b in enumerate(rest)}


class WordPieces(dict):
    """Token ids of words as little-endian bytes, at most about ``limit`` words.

    At half of that the words become the older ones, which are forgotten at the next time unless they occur again.

    A text's ids are those of its words in order, and a word is tokenised once. Lower-case Latin words go straight
    to the merges, since normalising and splitting leave them as they are; a full stop or comma after one is a token
    of its own. All other words take the whole way, many at a time with a bar between them, whose id marks the
    borders; words with a bar of their own go one by one.
    """

    BAR = b"|"

    def __init__(self, tokenizer, limit: int = 900_000):
        super().__init__()
        self.older: dict[bytes, bytes] = {}
        self.tokenizer, self.limit, self.merge = tokenizer, limit, tokenizer.model.tokenize
        self.spelling = _byte_letters()
        (self.bar,) = tokenizer.encode("|", add_special_tokens=False).ids
        self.marks = {m: self.whole(m) for m in (b".", b",")}

    def whole(self, word: bytes) -> bytes:
        return np.array(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def letters(self, word: bytes) -> bytes | None:
        """Ids of a lower-case word of Latin letters below U+0250; None for any other."""
        if word.isalpha() and word.islower():
            spelled = word.decode()
        else:
            text = word.decode()
            if not text.isalpha() or text != text.lower() or max(text) >= "\u0250":
                return None
            spelled = word.decode("latin-1").translate(self.spelling)
        ids = [t.id for t in self.merge(spelled)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def learn(self, words: list[bytes]) -> None:
        plain = []
        for word in words:
            tail = self.marks.get(word[-1:])
            ids = self.letters(word if tail is None else word[:-1])
            if ids is not None:
                self[word] = ids if tail is None else ids + tail
            elif self.BAR in word:
                self[word] = self.whole(word)
            else:
                plain.append(word)
        for at in range(0, len(plain), 500):
            some = plain[at:at + 500]
            joined = b" | ".join(some).decode()
            ids = np.array(self.tokenizer.encode(joined, add_special_tokens=False).ids, "<u4")
            raw, start = ids.tobytes(), 0
            for word, stop in zip(some, [*np.flatnonzero(ids == self.bar).tolist(), len(ids)], strict=True):
                self[word] = raw[4 * start:4 * stop]
                start = stop + 1

    def of(self, words: list[bytes]) -> bytes:
        missing = set(filterfalse(self.__contains__, words))
        if missing:
            if 2 * len(self) > self.limit:
                self.older = dict(self)
                self.clear()
                missing = set(words)
            again = missing & self.older.keys() if self.older else set()
            self.update((w, self.older[w]) for w in again)
            self.learn(list(missing - again))
        return b"".join(map(self.__getitem__, words))


def load_tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(1)
def word_pieces(path: str) -> WordPieces:
    """The memo of this Python worker, which its tasks fill and use one after another."""
    return WordPieces(load_tokenizer(path))


def pieces(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document with its closing id, cut only where too long."""
    closing = np.array([end], "<u4").tobytes()

    def cut(batches):
        memo = word_pieces(tokenizer_path)
        for batch in batches:
            rows = []
            for doc, text in rows_of([batch], "doc_id", "text"):
                words = tokenizer_words(text)
                ids = b"".join(memo.of(words[i:i + 100_000]) for i in range(0, len(words), 100_000)) + closing
                for i in range(0, len(ids), 4 * length):
                    part = ids[i:i + 4 * length]
                    rows.append((doc, i // (4 * length), i // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Individual:
    """Bins as tuples of item numbers; items are numbered by falling size."""

    def __init__(self, bins: list[tuple[int, ...]], sizes: list[int], room: int):
        self.bins = bins
        self.fill = [sum(sizes[i] for i in b) for b in bins]
        # Few bins, and among equals one with very full and very empty bins, whose empty ones may vanish.
        self.worth = (-len(bins), sum(f * f for f in self.fill) / (room * room))


def best_fit(items, sizes: list[int], room: int, bins: list[list[int]], left: list[int]) -> None:
    """Puts each item, in the given order, into the fullest bin it fits in, or a new one."""
    by_left: dict[int, list[int]] = {}
    mask = 0  # bit r set: some bin has r left
    for k, r in enumerate(left):
        by_left.setdefault(r, []).append(k)
        mask |= 1 << r
    for i in items:
        size = sizes[i]
        fitting = mask >> size
        if fitting:
            r = size + (fitting & -fitting).bit_length() - 1
            stack = by_left[r]
            k = stack.pop()
            if not stack:
                mask ^= 1 << r
            bins[k].append(i)
        else:
            k, r = len(bins), room
            bins.append([i])
        rest = r - size
        by_left.setdefault(rest, []).append(k)
        mask |= 1 << rest


def fresh(sizes: list[int], room: int, rng: random.Random, shuffle: float) -> Individual:
    """Best fit over falling sizes, each disturbed by up to ``shuffle`` of itself."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i] * (1 - shuffle * rng.random()))
    bins: list[list[int]] = []
    best_fit(order, sizes, room, bins, [])
    return Individual([tuple(b) for b in bins], sizes, room)


def crossover(a: Individual, b: Individual, sizes: list[int], room: int, rng: random.Random) -> Individual:
    """Well-filled bins of ``a`` go into ``b``; bins of ``b`` with a doubled item go; the displaced are refitted."""
    floor = room * (0.999 - 0.02 * rng.random())
    inject = [k for k, f in enumerate(a.fill) if f >= floor and rng.random() < 0.7]
    taken = {i for k in inject for i in a.bins[k]}
    bins, displaced = [list(a.bins[k]) for k in inject], []
    left = [room - a.fill[k] for k in inject]
    for k, group in enumerate(b.bins):
        if taken.isdisjoint(group) and (b.fill[k] >= floor or rng.random() < 0.5):
            bins.append(list(group))
            left.append(room - b.fill[k])
        else:
            displaced.extend(i for i in group if i not in taken)
    displaced.sort(key=lambda i: -sizes[i] * (1 - 0.05 * rng.random()))
    best_fit(displaced, sizes, room, bins, left)
    return Individual([tuple(x) for x in bins], sizes, room)


def evolve(sizes: list[int], room: int, elites: list[Individual], seed: int, generations: int = GENERATIONS,
           population: int = POPULATION) -> Individual:
    """The best individual after some generations; the elites given take part from the start."""
    rng = random.Random(seed)
    least = -(-sum(sizes) // room)
    people = list(elites)
    while len(people) < population:
        people.append(fresh(sizes, room, rng, 0.0 if len(people) == len(elites) else 0.3))
    people.sort(key=lambda p: p.worth, reverse=True)
    for _ in range(generations):
        if len(people[0].bins) == least:
            break
        born = []
        for _ in range(population):
            a, b = rng.sample(people[:3], 1)[0], rng.choice(people)
            born.append(crossover(a, b, sizes, room, rng))
        people = sorted(people + born, key=lambda p: p.worth, reverse=True)[:population]
    return people[0]


def _solve(items: DataFrame, room: int, label: str, islands: int, epochs: int) -> DataFrame:
    """``items`` (cell, item, length) packed cell by cell: (cell, item, bin)."""
    spread = items.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))))
    best = None
    for epoch in range(epochs):
        last = epoch == epochs - 1

        def live(key, mine: pd.DataFrame, guests: pd.DataFrame | None = None, epoch=epoch) -> pd.DataFrame:
            mine = mine.sort_values(["length", "item"], ascending=[False, True])
            sizes, names = mine["length"].tolist(), mine["item"].to_numpy()
            elites = []
            if guests is not None and len(guests):
                place = {name: at for at, name in enumerate(names.tolist())}
                for _, rows in guests.groupby("origin"):
                    bins = rows.assign(at=rows["item"].map(place)).groupby("bin")["at"].apply(tuple)
                    elites.append(Individual(bins.tolist(), sizes, room))
            won = evolve(sizes, room, elites, hash((int(key[0]), int(key[1]), epoch)))
            bin_of = np.empty(len(sizes), np.int32)
            fill = np.empty(len(sizes), np.int64)
            for k, group in enumerate(won.bins):
                bin_of[list(group)] = k
                fill[list(group)] = won.fill[k]
            return pd.DataFrame({"cell": key[0], "island": key[1], "item": names, "bin": bin_of, "fill": fill,
                                 "bins": len(won.bins), "squares": won.worth[1]})

        schema = "cell long, island int, item long, bin int, fill long, bins int, squares double"
        if best is None:
            best = spread.groupBy("cell", "island").applyInPandas(lambda key, mine: live(key, mine), schema)
        else:
            own = best.select("cell", "island", "item", "bin", F.lit(0).alias("origin"))
            moved = best.select("cell", ((F.col("island") + 1) % islands).alias("island"), "item", "bin",
                                F.lit(1).alias("origin"))
            best = spread.groupBy("cell", "island").cogroup(own.union(moved).groupBy("cell", "island")).applyInPandas(
                lambda key, mine, guests: live(key, mine, guests), schema)
        best = materialize(best, f"{label}-epoch")
        if last:
            break
    first = best.select("cell", "island", "bins", "squares").distinct().groupBy("cell").agg(
        F.min(F.struct("bins", -F.col("squares"), "island")).alias("m")).select("cell", F.col("m.island").alias("island"))
    return best.join(first, ["cell", "island"]).select("cell", "item", "bin", "fill")


def _cells(items: DataFrame, seed: int, size: int) -> DataFrame:
    """Deals items to cells of at most about ``size``; the number of cells follows the number of items."""
    n = items.count()
    return items.withColumn("cell", F.pmod(F.xxhash64("item", F.lit(seed)), F.lit(max(1, -(-n // size)))))


def _number(kind: int) -> Column:
    """A number no other sequence has; a cell has far fewer than 2^20 bins."""
    return (F.col("cell") * (1 << 20) + F.col("bin")) * 4 + kind


def pack(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, end: int = END, cell: int = CELL,
         islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """The pieces of all documents with ``sequence_id`` and ``offset``: no sequence holds more than ``length`` ids."""
    made = pieces(docs, tokenizer_path, length, end).withColumn("item", F.monotonically_increasing_id())
    made = materialize(made, "pack-pieces")  # fixes the item numbers
    small = made.where(F.col("length") < length).select("item", "length")
    once = _solve(_cells(small, 1, cell), length, "pack-1", islands, epochs)
    placed = materialize(once.join(small, "item"), "pack-placed")
    good = placed.where(F.col("fill") >= FULL * length).select(
        "item", _number(0).alias("sequence_id"))
    again = placed.where(F.col("fill") < FULL * length).select("item", "length")
    twice = _solve(_cells(again, 2, cell), length, "pack-2", islands, epochs).select(
        "item", _number(1).alias("sequence_id"))
    whole = made.where(F.col("length") >= length).select("item", (F.col("item") * 4 + 2).alias("sequence_id"))
    out = made.join(good.union(twice).union(whole), "item")
    before = Window.partitionBy("sequence_id").orderBy("item").rowsBetween(Window.unboundedPreceding, -1)
    return out.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence: its id, number of ids and pieces in order. A sequence has at most ``LENGTH`` pieces."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "start", "length")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_ids"), parts.alias("pieces"))
