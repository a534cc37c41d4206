"""Stupid-backoff language-model scores from relational n-gram counts.

The score of a word is c(w1 w2 w3) / c(w1 w2) if the n-gram was seen, else ALPHA times that of the shorter history;
a word never seen counts as ALPHA occurrences. A document's score is the sum of the logarithms (base 10). Counts are
over all documents of the corpus. When a corpus scores itself, a document's own occurrences are taken off the
counts first, or every n-gram would have been seen.

The relations: ``chunks`` (chunk, documents), ``n-grams`` (bucket, chunk, hashes, counts), ``totals`` (bucket, chunk,
counts in the corpus). N-grams are exploded per chunk of documents, added up there, and dealt by hash into buckets;
a bucket adds up the counts of all chunks and joins them back to every chunk that asked; chunks sum per document.
A row of the n-gram relation holds the sorted hashes that one chunk has in one bucket, so a frequent n-gram is one
entry per chunk, never a hot key, and sizes are bounded: ``CHUNK_WORDS`` words per chunk (or one longer document)
and about ``BUCKET_WORDS`` words of text per bucket.

N-grams are told apart by ``HASH_BITS`` bits of a 64-bit hash. Null and empty texts have no words and score zero.
Repeated rows are scored and counted once each. No documents give no rows.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silverbrook.llm.common import WordHashes, materialize, mix, rows_of, words

ORDER = 3
ALPHA = 0.4
CHUNK_WORDS = 1_000_000
BUCKET_WORDS = 1_500_000
HASH_BITS = 56


def packed_ints(values: np.ndarray) -> bytes:
    """Whole numbers as byte planes, compressed."""
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def unpacked_ints(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u8")


def chunks(docs: DataFrame, size: int = CHUNK_WORDS) -> DataFrame:
    """(chunk, n_words, body): documents (doc_id, text) gathered in parallel into compressed chunks."""
    def gather(batches):
        ids, texts, total = [], [], 0

        def close():
            body = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, body.schema) as out:
                out.write_batch(body)
            return pa.RecordBatch.from_arrays(
                [pa.array([uuid.uuid4().hex]), pa.array([total], pa.int64()),
                 pa.array([zstandard.compress(sink.getvalue(), 3)], pa.binary())], ["chunk", "n_words", "body"])

        for doc, text in rows_of(batches, "doc_id", "text"):
            n = len(words(text))
            if ids and total + n > size:
                yield close()
                ids, texts, total = [], [], 0
            ids.append(doc)
            texts.append(text)
            total += n
        if ids:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(gather, "chunk string, n_words long, body binary")


class Chunk:
    """The documents of a chunk with the hashes of their n-grams, order by order and word by word."""

    def __init__(self, body: bytes, memo: WordHashes):
        with pa.ipc.open_stream(zstandard.decompress(body)) as source:
            batch = source.read_next_batch()
        self.doc_ids = batch.column("doc_id").to_pylist()
        tokens, self.lengths = [], []
        for text in batch.column("text").to_pylist():
            mine = words(text)
            tokens += mine
            self.lengths.append(len(mine))
        self.lengths = np.array(self.lengths, np.int64)
        self.doc = np.repeat(np.arange(len(self.lengths)), self.lengths)
        starts = np.cumsum(self.lengths) - self.lengths
        self.position = np.arange(len(tokens)) - starts[self.doc]
        drop = np.uint64(64 - HASH_BITS)
        one = memo.of(tokens)
        two, three = np.zeros_like(one), np.zeros_like(one)
        two[1:] = mix(one[:-1], one[1:])
        three[2:] = mix(two[1:-1], ~one[2:])
        self.grams = [one >> drop, two >> drop, three >> drop]
        self.valid = [self.position >= k for k in range(ORDER)]
        self.distinct, counts = np.unique(
            np.concatenate([g[v] for g, v in zip(self.grams, self.valid, strict=True)]), return_counts=True)
        self.counts = counts.astype(np.uint64)

    def scores(self, totals: np.ndarray, corpus_words: int, own: bool) -> tuple[np.ndarray, np.ndarray]:
        """Sum of log10 per document, and how many of its words were found with the full history."""
        at = [np.searchsorted(self.distinct, g) for g in self.grams]
        c = []
        for place, valid in zip(at, self.valid, strict=True):
            n = np.zeros(len(place))
            n[valid] = totals[place[valid]]
            if own:
                key = self.doc[valid] * np.int64(len(self.distinct)) + place[valid]
                _, back, times = np.unique(key, return_inverse=True, return_counts=True)
                n[valid] -= times[back]
            c.append(n)
        rest = np.maximum(1, corpus_words - (self.lengths if own else 0))
        rest = np.broadcast_to(rest, self.lengths.shape)[self.doc]
        before = [np.concatenate([[1.0], x[:-1]]) for x in c]  # counts of the history
        s = ALPHA ** np.minimum(self.position, 2) * np.where(c[0] > 0, c[0], ALPHA) / rest
        with np.errstate(divide="ignore", invalid="ignore"):
            s = np.where(c[1] > 0, ALPHA ** (self.position >= 2) * c[1] / before[0], s)
            s = np.where(c[2] > 0, c[2] / before[1], s)
        n_docs = len(self.lengths)
        return np.bincount(self.doc, np.log10(s), n_docs), np.bincount(self.doc[c[2] > 0], minlength=n_docs)


def ngrams(chunk_table: DataFrame, buckets: int, counted: bool, asked: bool) -> DataFrame:
    """(bucket, chunk, hashes, counts, counted, asked): the distinct n-grams of every chunk by bucket of the hash."""
    bounds = np.array([(i << HASH_BITS) // buckets for i in range(1, buckets)], np.uint64)

    def explode(batches):
        memo = WordHashes()
        for name, body in rows_of(batches, "chunk", "body"):
            mine = Chunk(body, memo)
            edges = [0, *np.searchsorted(mine.distinct, bounds).tolist(), len(mine.distinct)]
            full = [b for b in range(buckets) if edges[b] < edges[b + 1]]
            for at in range(0, len(full), 64):
                some = full[at:at + 64]
                part = [slice(edges[b], edges[b + 1]) for b in some]
                yield pa.RecordBatch.from_arrays([
                    pa.array(some, pa.int32()), pa.array([name] * len(some)),
                    pa.array([packed_ints(np.diff(mine.distinct[p], prepend=np.uint64(0))) for p in part], pa.binary()),
                    pa.array([packed_ints(mine.counts[p]) for p in part], pa.binary()),
                ], ["bucket", "chunk", "hashes", "counts"])

    made = chunk_table.select("chunk", "body").mapInArrow(explode, "bucket int, chunk string, hashes binary, counts binary")
    return made.withColumns({"counted": F.lit(counted), "asked": F.lit(asked)})


def totals(grams: DataFrame) -> DataFrame:
    """(chunk, bucket, totals): for every chunk that asked, the corpus counts of its n-grams in order."""
    def add(group: pa.Table) -> pa.Table:
        chunk, bucket, hashes, counts, asked = [], [], [], [], []
        for b, c, h, n, counted, ask in rows_of(group.to_batches(), "bucket", "chunk", "hashes", "counts", "counted", "asked"):
            bucket.append(b)
            chunk.append(c)
            hashes.append(np.cumsum(unpacked_ints(h), dtype=np.uint64))
            counts.append(unpacked_ints(n) * np.uint64(counted))
            asked.append(ask)
        distinct, back = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(back, np.concatenate(counts).astype(float), len(distinct))
        edges = np.cumsum([0, *map(len, hashes)])
        ask = [i for i, a in enumerate(asked) if a]
        return pa.table({
            "chunk": pa.array([chunk[i] for i in ask], pa.string()), "bucket": pa.array([bucket[i] for i in ask], pa.int32()),
            "totals": pa.array([packed_ints(total[back[edges[i]:edges[i + 1]]]) for i in ask], pa.binary())})

    return grams.groupBy("bucket").applyInArrow(add, "chunk string, bucket int, totals binary")


def lm_scores(docs: DataFrame, corpus: DataFrame | None = None, bucket_words: int = BUCKET_WORDS,
              chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """(doc_id, n_words, n_full, score) per row of ``docs``, by counts of ``corpus`` or else of ``docs`` themselves.

    n_full counts the words found with the full history.
    """
    own = corpus is None
    asking = materialize(chunks(docs, chunk_words), "lm-chunks")
    counting = asking if own else materialize(chunks(corpus, chunk_words), "lm-corpus")
    size = counting.agg(F.sum("n_words")).first()[0] or 0
    asked = size if own else asking.agg(F.sum("n_words")).first()[0] or 0
    buckets = max(1, -(-max(size, asked) // bucket_words))
    grams = ngrams(asking, buckets, own, True)
    if not own:
        grams = grams.union(ngrams(counting, buckets, True, False))

    def finish(body: pa.Table, answers: pa.Table) -> pa.Table:
        rows, memo = [], WordHashes()
        for data in body.column("body").to_pylist():
            mine = Chunk(data, memo)
            answers = answers.sort_by("bucket")
            found = [unpacked_ints(t) for t in answers.column("totals").to_pylist()]
            total = np.concatenate(found).astype(float) if found else np.zeros(0)
            score, full = mine.scores(total, size, own) if len(total) else (np.zeros(len(mine.doc_ids)),) * 2
            rows.append(pa.table({
                "doc_id": pa.array(mine.doc_ids, pa.int64()), "n_words": pa.array(mine.lengths),
                "n_full": pa.array(full.astype(np.int64)), "score": pa.array(score)}))
        return pa.concat_tables(rows) if rows else pa.table(
            {"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()),
             "n_full": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})

    return asking.select("chunk", "body").groupBy("chunk").cogroup(totals(grams).groupBy("chunk")).applyInArrow(
        finish, "doc_id long, n_words long, n_full long, score double")
