"""Raw texts and table writers on small cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerwell.sources import raw, tables


def test_exports_keep_cash_rows(spark, tmp_path):
    text = 'Action,Time (UTC),ID,Ticker,Total,Notes\nDeposit,2024-01-02 10:00:00,a,,"1,5",x\nDeposit,2024-01-02 10:00:00,b,, 12.50 ,"two\nlines ""q"""\nMarket buy,2024-01-02 10:00:00,c,ABC,1,\nDeposit,bad,d,,1,\nDeposit,2024-01-02 10:00:00,,,1,\n'
    (tmp_path / "x.csv").write_text(text)
    got = {r.row_id: (r.total and float(r.total), r.notes, r.merchant_name) for r in raw.read_export(spark, str(tmp_path / "x.csv")).collect()}
    assert got == {"a": (None, "x", None), "b": (12.5, 'two\nlines "q"', None)}
    (tmp_path / "y.csv").write_text("Action,Total\nDeposit,1\n")
    with pytest.raises(ValueError):
        raw.read_export(spark, str(tmp_path / "y.csv"))


def test_feeds_of_both_kinds(spark):
    rss = "<rss><channel><item><title><![CDATA[A & B]]></title><link>http://x/1</link><pubDate>d</pubDate></item><item><title>no link</title></item><item><title> </title><link>http://x/2</link></item></channel></rss>"
    atom = '<feed><entry a="1"><title type="text">C &amp; D &lt;</title><link rel="alternate" href="https://x/3"/><updated>e</updated><summary>s</summary></entry></feed>'
    rows = raw.feed_items(spark.createDataFrame([(1, rss), (2, atom), (3, "not xml"), (4, None), (5, "<!DOCTYPE r [<!ENTITY x 'y'>]><r/>")], "k int, body string"), "body").collect()
    assert sorted(tuple(r) for r in rows) == [(1, "A & B", "http://x/1", "d", None), (2, "C & D <", "https://x/3", "e", "s")]


def test_facts_keep_the_latest_filing_and_concept(spark):
    body = '{"facts":{"us-gaap":{"A":{"units":{"USD":[{"start":"2023-01-01","end":"2023-12-31","val":1,"filed":"2024-01-01"},{"start":"2023-01-01","end":"2023-12-31","val":2,"filed":"2024-06-01"}]}},"B":{"units":{"USD":[{"end":"2022-12-31","val":9,"filed":"2023-01-01"}]}}}}}'
    rows = raw.company_facts(spark.createDataFrame([(1, body), (2, "{}"), (3, None)], "k int, body string"), "body", ("B", "A")).collect()
    assert [(r.k, r.concept, r.end, r.val) for r in rows] == [(1, "A", dt.date(2023, 12, 31), 2.0)]


def test_calendar_lines_are_escaped_and_folded(spark):
    rows = [("a:1", dt.date(2024, 2, 29), "x;y,z\\", "l1\nl2 " + "w" * 160)]
    entry = tables.calendar_entries(spark.createDataFrame(rows, "id string, day date, summary string, description string"), "T").first().entry
    lines = entry.split("\r\n")
    assert "UID:a-1@ledgerwell.local" in lines and "DTEND;VALUE=DATE:20240301" in lines and "SUMMARY:x\\;y\\,z\\\\" in lines and max(map(len, lines)) <= 74
    assert "DESCRIPTION:l1\\nl2 " + "w" * 160 in entry.replace("\r\n ", "")


def test_writers(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (2, "d"), (3, "e")], "k int, v string")
    assert sorted(map(tuple, tables.upsert(old, new, ["k"], "v").collect())) == [(1, "a"), (2, "d"), (3, "e")]
    assert sorted(r.k for r in tables.insert_new(old, new, "k").collect()) == [1, 2, 3]
    assert tables.upsert(old, new.filter(F.lit(False)), ["k"]).count() == 2
