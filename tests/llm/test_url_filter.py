import time
from datetime import datetime

from fieldloom.llm import url_filter

DAY = [datetime(2024, 1, d) for d in range(1, 29)]
ENTRIES = [
    ("a", "domain", "example.com", DAY[2], "add"), ("a", "domain", "example.com", DAY[6], "remove"), ("a", "domain", "example.com", DAY[9], "add"),
    ("b", "host", "x.example.com", DAY[0], "add"), ("b", "host", "x.example.com", DAY[0], "add"),
    ("c", "url", "site.org/bad", DAY[1], "add"), ("d", "host", "same.org", DAY[1], "add"), ("d", "host", "same.org", DAY[1], "remove"),
    (None, "host", "site.org", DAY[1], "add"), ("e", "host", None, DAY[1], "add"),
]
CAPTURES = [
    (1, "http://example.com/", DAY[1], ""), (2, "http://example.com/", DAY[2], "a"), (3, "https://w.EXAMPLE.com.:80/p", DAY[5], "a"),
    (4, "http://example.com/", DAY[6], ""), (5, "http://x.example.com/q?z", DAY[10], "a,b"), (6, "http://notexample.com/", DAY[10], ""),
    (7, "http://site.org/bad/page", DAY[3], "c"), (8, "http://site.org/badder", DAY[3], ""), (9, "http://same.org/", DAY[3], ""),
    (10, None, DAY[3], ""), (11, "nonsense", DAY[3], ""), (12, "http://example.com/", None, ""), (2, "http://example.com/", DAY[2], "a"), (None, "http://u@example.com", DAY[3], "a"),
]


def test_validity(spark):
    entries = spark.createDataFrame(ENTRIES, "list_name string, kind string, pattern string, listed_at timestamp, action string")
    captures = spark.createDataFrame([c[:3] for c in CAPTURES], "page_id long, url string, fetched_at timestamp")
    got = url_filter.judged(captures, entries).select("page_id", "url", "fetched_at", "verdict.lists", "verdict.blocked").collect()
    assert sorted(map(str, [(r.page_id, r.url, r.lists, r.blocked) for r in got])) == sorted(map(str, [(i, u, l, l != "") for i, u, _, l in CAPTURES]))
    none = url_filter.judged(captures, entries.where("false")).where("verdict.blocked").count()
    assert none == 0 and url_filter.url_filter(captures.where("false"), entries).count() == 0


def test_crowded_patterns_and_clashing_names(spark, monkeypatch):
    """Windows of few captures give the same verdicts, and the captures' own columns stay."""
    entries = spark.createDataFrame(ENTRIES, "list_name string, kind string, pattern string, listed_at timestamp, action string")
    rows = [(i, f"http://example.com/{'p' * (10_000 if i == 7 else i)}", DAY[i % 25], "u", "t", "own", 5) for i in range(200)]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched_at timestamp, _u string, _t string, verdict string, c0 int")
    found = {}
    for most in (7, 10_000):
        monkeypatch.setattr(url_filter, "SALT_ROWS", most)
        found[most] = sorted(map(str, url_filter.judged(captures, entries).collect()))
    assert found[7] == found[10_000] and len(found[7]) == 200
    for r in url_filter.judged(captures, entries).collect():
        assert (r._u, r._t, r.verdict, r.c0) == ("u", "t", "own", 5)
        assert r.verdict_2.blocked == (DAY[2] <= r.fetched_at < DAY[6] or DAY[9] <= r.fetched_at)


def test_very_many_segments_and_labels(spark):
    """Urls of 100,000 segments or labels, in seconds; what the list names is found at any depth."""
    deep = "/".join(f"s{i}" for i in range(300))
    entries = spark.createDataFrame([("a", "url", f"long.org/{deep}", DAY[1], "add"), ("b", "url", "long.org", DAY[1], "add"), ("c", "domain", "x.y.org", DAY[1], "add"), ("d", "url", "long.org/s0/s1/", DAY[1], "add")], "list_name string, kind string, pattern string, listed_at timestamp, action string")
    many = "/".join(f"s{i}" for i in range(100_000))
    rows = [(1, f"http://long.org/{many}", DAY[3]), (2, f"http://long.org//{many}?q", DAY[3]), (3, f"http://other.org/{many}", DAY[3]), (4, "http://" + "z." * 100_000 + "x.y.org/", DAY[3]), (5, "http://long.org/s0", DAY[3]), (6, "http://" + "z." * 100_000 + "w.org/", DAY[3])]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched_at timestamp")
    began = time.time()
    got = {r.page_id: r.lists for r in url_filter.judged(captures, entries).select("page_id", "verdict.lists").collect()}
    assert got == {1: "a,b", 2: "a,b", 3: "", 4: "c", 5: "b", 6: ""} and time.time() - began < 60
