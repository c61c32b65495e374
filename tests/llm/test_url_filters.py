from __future__ import annotations

from adperf.llm import queries, url_filters
from tests.comparing import differences, duck


def test_equals_sql_over_the_given_pages(spark, sf_dir):
    df = queries.op7_url_filters(spark, sf_dir)
    assert differences(df, duck(sf_dir), queries.oracle_sql()["op7_url_filters"]) is None
    assert {r.blocked for r in df.collect()} == {True, False}


ENTRIES = "pattern string, list string, action string, since long"


def judged(spark, captures, entries):
    pages = spark.createDataFrame(captures, "url string, fetched_at long, pattern string, until string")
    rows = url_filters.judge(pages, spark.createDataFrame(entries, ENTRIES)).collect()
    return sorted(((r.url or "", r.fetched_at or 0, r.matched_pattern, r.blocked) for r in rows), key=repr)


def test_entries_active_at_fetch_time_decide(spark):
    entries = [
        ("bad.example", "block", "add", 10), ("bad.example", "block", "remove", 20), ("bad.example", "block", "add", 30),
        ("ok.bad.example", "allow", "add", 12), ("same.example", "block", "add", 5), ("same.example", "allow", "add", 5),
        ("now.example", "block", "remove", 7), ("now.example", "block", "add", 7), (None, "block", "add", 1),
        ("null.example", "block", None, 1),
    ]
    captures = [(f"http://{h}/x", t, "p", "u") for h, t in [
        ("bad.example", 9), ("bad.example", 10), ("WWW.bad.example:80", 19), ("bad.example", 20), ("bad.example", 31),
        ("ok.bad.example", 11), ("ok.bad.example", 12), ("same.example", 6), ("now.example", 7), ("null.example", 9),
        ("notbad.example", 15),
    ]]
    got = judged(spark, captures, entries)
    blocked = {(u, t) for u, t, _, b in got if b}
    assert blocked == {
        ("http://bad.example/x", 10), ("http://WWW.bad.example:80/x", 19), ("http://bad.example/x", 31),
        ("http://ok.bad.example/x", 11), ("http://now.example/x", 7),
    }
    assert len(got) == len(captures)


def test_odd_captures_and_empty_tables(spark):
    captures = [(None, 5, None, None), ("no host", 5, None, None), ("", 5, None, None), ("http://a.b/", None, None, None),
                ("http://a.b/", 5, None, None), ("http://a.b/", 5, None, None)]
    got = judged(spark, captures, [("b", "block", "add", 1)])
    assert [r[3] for r in got].count(True) == 2 and len(got) == 6
    assert not any(r[3] for r in judged(spark, captures, []))
    assert judged(spark, [], [("b", "block", "add", 1)]) == []
