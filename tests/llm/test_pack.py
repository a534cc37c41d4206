import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from silverbrook.llm import pack as pk
from silverbrook.llm.common import tokenizer_file
from silverbrook.llm.queries import QUERIES

FILE = tokenizer_file("word_bpe_49k.json")


def plain_ids(text):
    return [*Tokenizer.from_file(FILE).encode(text or "", add_special_tokens=False).ids, 0]


def checked(rows, texts, length=2048):
    """Every document once, cut right, and every sequence gapless and not too long; the number of sequences."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == texts.keys()
    tokenizer = Tokenizer.from_file(FILE)
    for doc, parts in by_doc.items():
        ids = np.array([*tokenizer.encode(texts[doc] or "", add_special_tokens=False).ids, 0], "<u4")
        want = [(i // length, i, len(ids[i:i + length]), zlib.crc32(ids[i:i + length].tobytes()))
                for i in range(0, len(ids), length)]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in parts) == want
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
    return len(by_sequence)


def test_words_are_tokenised_as_the_whole_text(spark):
    texts = ["It's THE end, isn't it?  Yes... a.b, c|d | e.", "Ä̈J̌ Kİ ΑΣ, ος. İx", "x.\n\ny,\tz\x1cq r ",
             "<|endoftext|> a<|startoftext|>b", "a" * 5000 + ". " + "é" * 3000, "", "''s 12,345.67 'll", "ÅÅﬁ ½"]
    memo = pk.WordPieces(pk.load_tokenizer(FILE))
    for text in texts:
        assert np.frombuffer(memo.of(pk.tokenizer_words(text)), "<u4").tolist() == plain_ids(text)[:-1], text


def test_special_tokens_are_matched_before_lower_case():
    memo = pk.WordPieces(pk.load_tokenizer(FILE))
    for text in ("<|ENDOFTEXT|>", "One <|EndOfText|>, TWO <|endoftext|>Three <|STARTOFTEXT|>"):
        assert np.frombuffer(memo.of(pk.tokenizer_words(text)), "<u4").tolist() == plain_ids(text)[:-1], text
    assert plain_ids("<|ENDOFTEXT|>")[:-1] == [27, 347, 40786, 4160, 91, 285]


def test_all_documents(spark, small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = QUERIES["op6_best_fit_packing"](spark, small).collect()
    assert checked(rows, texts) <= 1.02 * -(-sum(r.length for r in rows) // 2048) + 1


def test_crossover_keeps_every_item():
    rng = random.Random(4)
    sizes = sorted((rng.randrange(1, 101) for _ in range(200)), reverse=True)
    a, b = pk.fresh(sizes, 100, rng, 0.3), pk.fresh(sizes, 100, rng, 0.3)
    for _ in range(30):
        child = pk.crossover(a, b, sizes, 100, rng)
        assert sorted(i for g in child.bins for i in g) == list(range(200)) and max(child.fill) <= 100
        a, b = b, child
    best = pk.evolve(sizes, 100, [], 1)
    assert len(best.bins) <= len(pk.fresh(sizes, 100, rng, 0.0).bins)


def test_islands_and_odd_rows(spark, docs_of):
    rng = random.Random(9)
    docs = [(i, " ".join(rng.choice(["one", "two", "three"]) for _ in range(rng.randrange(70)))) for i in range(150)]
    docs += [(1000, None), (1001, ""), (1002, "four " * 1000)]
    rows = pk.pack(docs_of(docs), FILE, length=64, cell=20, islands=3, epochs=3).collect()
    n = checked(rows, dict(docs), 64)
    assert n <= 1.1 * -(-sum(r.length for r in rows) // 64) + 3
    same = pk.pack(docs_of([(7, "a b"), (7, "a b"), (None, "c")], "doc_id long, text string"), FILE).collect()
    assert sorted((r.doc_id or 0, r.length, r.offset) for r in same)[0][1] == 2 and len(same) == 3
    assert len({r.sequence_id for r in same}) == 1 and sorted(r.offset for r in same) == [0, min(
        r.length for r in same if r.offset == 0), sum(r.length for r in same if r.offset < max(x.offset for x in same))]
    assert pk.pack(docs_of([]), FILE).collect() == []
    assert [r.n_ids for r in pk.sequences(pk.pack(docs_of([(1, "a b c")]), FILE)).collect()] == [4]


def test_words_are_learnt_once_a_worker():
    assert pk.word_pieces(FILE) is pk.word_pieces(FILE)
    memo, learnt = pk.WordPieces(pk.load_tokenizer(FILE), limit=8), []
    learn = memo.learn
    memo.learn = lambda words: (learnt.extend(words), learn(words))
    words = [b"one", b"two", b"three", b"four", b"five", b"two", b"six"]
    for some in (words[:5], words[5:], words[5:6], words[:1]):
        assert np.frombuffer(memo.of(some), "<u4").tolist() == plain_ids(b" ".join(some).decode())[:-1]
    assert sorted(learnt) == sorted(set(words))  # a full memo forgets no word that is still in use
    for i in range(60):
        memo.of([b"w%d" % i])
        assert len(memo) + len(memo.older) <= 12
