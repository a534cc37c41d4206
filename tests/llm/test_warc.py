import gzip
import hashlib
import io
import random

from llm_compare import agree

from silverbrook.llm import warc as w

SCHEMA = "page_id long, url string, html string"


def test_query_agrees_with_sql(spark, small):
    agree(spark, small, "op7_warc")


def test_round_trip_in_chunks(spark, docs_of, tmp_path):
    rng = random.Random(1)
    big = "".join(rng.choice("aé😀\r\n ") for _ in range(5000))
    rows = [(5, "http://a", big), (3, "http://b\r\nX: y", big), (9, None, big), (1, "u", "x" * 99), (2, "u", "x" * 99), (4, "", None),
            (6, "u", ""), (7, "v", "y" * 100), (8, "v", "y" * 100), (8, "v", "y" * 100), (7, "v", "y" * 100), (None, "n", "z" * 200)]
    records = w.plan_records(docs_of(rows, SCHEMA))
    manifest = w.write_archives(records, str(tmp_path / "one"), limit=500)
    table = w.read_archives(manifest, chunk=64).collect()
    bodies = {}
    for r in sorted(table, key=lambda r: (r.path, r.ordinal, r.chunk_no)):
        key = r.path, r.ordinal
        bodies[key] = bodies.get(key, b"") + r.data
        assert r.total_bytes == len(bodies[key]) and r.sha256 == hashlib.sha256(bodies[key]).hexdigest()
    got = sorted(((r.page_id or 0, r.record_type, r.refers_to, bodies[r.path, r.ordinal].decode()) for r in table if r.last), key=repr)
    want = []
    for page, _, html in rows:
        html = html or ""
        first = min((p for p, _, h in rows if h == html and p is not None), default=None) if len(html.encode()) >= 100 else page
        again = first is not None and page != first
        want.append((page or 0, "revisit" if again else "response", first if again else None, "" if again else html))
    assert got == sorted(want, key=repr)
    assert sum(r.records for r in manifest.collect()) == len(rows)


def test_archives_are_plain_warc(spark, docs_of, tmp_path):
    manifest = w.write_archives(w.plan_records(docs_of([(1, "http://a", "hällo" * 40)], SCHEMA)), str(tmp_path)).collect()
    text = gzip.open(manifest[0].path, "rb").read()
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and text.endswith(b"\r\n\r\n")
    head, _, rest = text.partition(b"\r\n\r\n")
    length = int(next(x for x in head.split(b"\r\n") if x.startswith(b"Content-Length")).split(b": ")[1])
    assert len(rest) == length + 4 and rest[:-4].endswith("hällo".encode())


def test_damage_is_found(spark, docs_of, tmp_path):
    manifest = w.write_archives(w.plan_records(docs_of([(1, "u", "abc" * 100)], SCHEMA)), str(tmp_path)).collect()
    data = gzip.open(manifest[0].path, "rb").read().replace(b"abcabc", b"abXabc")
    chunks = list(w.read_chunks(io.BytesIO(gzip.compress(data))))
    headers = chunks[-1][1]
    assert headers["warc-payload-digest"] != f"sha256:{chunks[-1][5]}"
    try:
        list(w.read_chunks(io.BytesIO(gzip.compress(data[:-60]))))
        raise AssertionError
    except ValueError as error:
        assert "ends inside" in str(error)


def test_no_pages(spark, docs_of):
    assert w.round_trip(spark, docs_of([], SCHEMA)).collect() == []
