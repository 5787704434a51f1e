import base64
import gzip
import hashlib

from fieldloom.llm import queries, warc

PAGES = [
    (3, "http://a/", "<p>one\r\n\r\nWARC/1.1\r\n\r\n</p>"), (1, "http://b/", "same"), (2, None, "same"), (4, "http://c/\r\nX: y", None), (5, "http://d/", ""),
    (6, "http://e/", "é東🙂" * 50_000), (None, "http://f/", "same"), (None, "http://g/", "alone"), (1, "http://b/", "same"), (7, "http://h/", "one\r\n\r\n"),
]


def want(least=0):
    """A row for each page: the first of equal payloads by page_id, nulls last, is the response."""
    out, seen = [], {}
    for i, _, h in sorted(PAGES, key=lambda p: (p[0] is None, p[0] or 0)):
        data = (h or "").encode()
        kind = "revisit" if data in seen and len(data) >= least else "response"
        refers = seen.get(data) if kind == "revisit" else None
        seen.setdefault(data, i)
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), kind, refers, True, True))
    return sorted(map(str, out))


def test_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    got = warc.capture_rows(warc.captures(pages, str(tmp_path / "w")))
    assert sorted(str(tuple(r)) for r in got.collect()) == want()
    assert sorted(str(tuple(r)) for r in warc.capture_rows(warc.captures(pages, min_revisit_bytes=10)).collect()) == want(10)
    for f in (tmp_path / "w").glob("part-*"):
        for _, head, block in warc.parsed(gzip.decompress(f.read_bytes())):
            assert len(block) == int(head["content-length"]) and head["warc-record-id"].startswith("<urn:uuid:")


def test_long_pages_have_files_of_their_own(spark, tmp_path):
    rows = [(i, f"http://{i}/", ("x" if i % 7 else "long " * 300_000) + str(i)) for i in range(70)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    assert warc.captures(pages, str(tmp_path / "w")).where("response.digest_ok").count() == 70
    sizes = [len(gzip.decompress(f.read_bytes())) for f in (tmp_path / "w").glob("part-*")]
    assert max(sizes) < 1_600_000 and sum(s > 1_000_000 for s in sizes) == 10


def test_every_row_comes_back(spark, tmp_path):
    rows = [(None, "http://a/", ""), (None, "http://b/", None), (None, "http://b/", ""), (1, "http://c/", "x"), (1, "http://c/", "x"), (1, "http://d/", "x"), (2, "http://e/", "x")]
    schema = "page_id long, url string, html string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to, r.complete) for r in queries.op4_warc(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted([(0, 0, "response", None, True)] + [(0, 0, "revisit", None, True)] * 2 + [(1, 1, "response", None, True)] + [(1, 1, "revisit", 1, True)] * 2 + [(2, 1, "revisit", 1, True)], key=str)
    import duckdb

    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    told = sorted((r[0] or 0, r[1], r[3], r[4], r[6]) for r in db.execute(warc.ORACLE).fetchall())
    assert sorted(told, key=str) == sorted(got, key=str)
    found = warc.captures(spark.read.parquet(str(tmp_path / "pages.parquet"))).collect()
    ids = {r.response.record_id for r in found}
    assert len(found) == len(ids) == 7 and all(r.response.refers_to in ids for r in found if r.response.warc_type == "revisit")
    assert {r.response.target_uri for r in found} == {f"http://{x}/" for x in "abcde"}


def test_pointer_at_a_request(spark):
    names = "file string, record_offset long, record_id string, warc_type string, concurrent_to string"
    rows = [("f", 0, "r", "response", None), ("f", 1, "q", "request", "r"), ("f", 2, "m", "metadata", "q"), ("f", 3, "x", "request", "gone")]
    found = warc.assemble(spark.createDataFrame(rows, names)).collect()
    assert len(found) == 1 and found[0].metadata.record_id == "m" and found[0].request.record_id == "q"


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.captures(pages).count() == 0
