from datetime import date

from tradelake.llm import url_lists as U

ENTRIES = [
    ("host", "a.example.com", date(2024, 1, 10), "add"), ("host", "a.example.com", date(2024, 2, 1), "remove"),
    ("host", "a.example.com", date(2024, 6, 1), "add"), ("host", "a.example.com", date(2024, 7, 1), "add"),
    ("domain", "example.com", date(2024, 3, 5), "add"), ("domain", "example.com", date(2024, 3, 5), "remove"),
    ("domain", "bad.org", date(2024, 1, 31), "add"), ("prefix", "c.net/spam", date(2023, 5, 1), "add"),
    ("host", None, date(2024, 1, 1), "add"), (None, "x", date(2024, 1, 1), "add"), ("host", "z.com", None, "add"), ("host", "c.net", date(2024, 1, 1), "maybe"),
    ("domain", "never.org", date(2024, 1, 1), "remove"),
]
CASES = [
    ("http://A.example.com:80/x", date(2024, 1, 9), None), ("http://a.example.com./", date(2024, 1, 10), "host"),
    ("https://u@a.example.com?q", date(2024, 1, 31), "host"), ("http://a.example.com", date(2024, 2, 1), None),
    ("http://a.example.com", date(2024, 12, 31), "host"), ("http://b.example.com", date(2024, 3, 5), None),
    ("http://deep.sub.bad.org/p", date(2024, 1, 31), "domain"), ("http://notbad.org", date(2024, 5, 1), None),
    ("http://c.net/spam/page", date(2024, 5, 1), "prefix"), ("http://c.net/spammer", date(2024, 5, 1), None),
    (None, date(2024, 5, 1), None), ("no url", date(2024, 5, 1), None), ("http://bad.org", None, None), ("", date(2024, 5, 1), None),
]


def test_entries_active_at_fetch_time(spark):
    entries = spark.createDataFrame(ENTRIES, "kind string, key string, listed_on date, action string")
    rows = [(k, *c[:2], "x") for k, c in enumerate(CASES)] + [(1, *CASES[1][:2], "x")]
    captures = spark.createDataFrame(rows, "id int, url string, fetched_on date, kind string")
    got = sorted((r.row.id, r.kind, r.blocked) for r in U.judge(captures, entries).collect())
    want = sorted((k, c[2], c[2] is not None) for k, c in [*enumerate(CASES), (1, CASES[1])])
    assert got == sorted(want)


def test_empty(spark):
    captures = spark.createDataFrame([(1, "http://a.b", date(2024, 1, 1))], "id int, url string, fetched_on date")
    entries = spark.createDataFrame(ENTRIES, "kind string, key string, listed_on date, action string")
    assert U.judge(captures, entries.limit(0)).where("blocked").count() == 0
    assert U.judge(captures.limit(0), entries).count() == 0
