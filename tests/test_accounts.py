"""Plans, contexts, flags, freshness, symbols, reports and versions of tables: cases worked by hand."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerwell.functions import storage
from ledgerwell.operators import accounts as ac

NOW = datetime(2024, 1, 30)


def test_plans_are_replaced_whole_or_not_at_all(spark):
    schema = "account_id int, ticker string, weight double"
    old = spark.createDataFrame([(1, "A", 0.5), (1, "B", 0.5), (2, "A", 1.0), (3, "A", 0.1)], schema)
    new = spark.createDataFrame([(1, "C", 0.7), (1, "D", 0.30005), (1, "E", 0.0), (2, "A", 0.7), (2, "B", 0.3002), (4, "A", 0.0)], schema)
    plans, refused = ac.replace_plans(old, new)
    assert {tuple(r) for r in plans.collect()} == {(1, "C", 0.7), (1, "D", 0.30005), (2, "A", 1.0), (3, "A", 0.1)}
    assert [r["account_id"] for r in refused.collect()] == [2]


def test_context_of_holdings(spark):
    day = date(2024, 1, 2)
    rows = [(1, "A", day, 30.0), (1, "B", day, 10.0), (1, "C", day, None), (1, "A", day - timedelta(days=1), 99.0), (2, "A", day, 5.0), (2, "B", day, -5.0)]
    holdings = spark.createDataFrame(rows, "account_id int, ticker string, as_of_date date, market_value_eur double")
    news = spark.createDataFrame([("A", NOW + timedelta(hours=i), f"h{i}") for i in range(7)] + [("B", None, "undated"), ("A", None, "undated")], "ticker string, ts timestamp, headline string")
    got = {(r["account_id"], r["ticker"]): tuple(r)[2:] for r in ac.holding_context(holdings, news).collect()}
    assert got == {(1, "A"): (0.75, 5, "h6"), (1, "B"): (0.25, 1, "undated"), (2, "A"): (None, 5, "h6"), (2, "B"): (None, 1, "undated")}


def test_freshness_due_fetches_and_symbols(spark):
    rows = spark.createDataFrame([("success", NOW - timedelta(hours=24)), ("success", NOW - timedelta(hours=24, seconds=1)), ("failed", NOW), (None, NOW), ("success", None)], "s string, t timestamp")
    assert [r[0] for r in rows.select(ac.is_fresh(F.col("s"), F.col("t"), F.lit(NOW), 24)).collect()] == [True, False, False, False, False]
    ago = lambda hours: None if hours is None else NOW - timedelta(hours=hours)
    fetches = spark.createDataFrame([("earnings", "E1", ago(20)), ("earnings", "E2", ago(19)), ("earnings", "E3", None)] + [("dividends", f"D{i}", ago(h)) for i, h in enumerate((168, 200, 167, None, 300, 250, 169))], "kind string, ticker string, fetched_at timestamp")
    assert {r["ticker"] for r in ac.due(fetches, F.lit(NOW)).collect()} == {"E1", "E3", "D3", "D4", "D5", "D1"}
    names = spark.createDataFrame([("NVDA_US_EQ",), ("VUAGl_EQ",), ("abc_EQ",), ("X",), (None,)], "t string").select(ac.plain_symbol(F.col("t"))).collect()
    assert [r[0] for r in names] == ["NVDA", "VUAG", "abc", "X", None]
    instruments = spark.createDataFrame([("A", "aa"), ("B", "aa"), ("C", None), ("D", "")], "ticker string, symbol string")
    found = ac.ticker_of_symbol(spark.createDataFrame([("AA", 1), ("", 2), ("ZZ", 3)], "code string, n int"), instruments, "code", F.upper("symbol"))
    assert [tuple(r) for r in found.collect()] == [("AA", 1, "B")]
    wanted = ac.price_requests(instruments.withColumn("currency", F.lit("USD")), spark.createDataFrame([("k", "K.L", "GBP")], "key string, symbol string, currency string"), spark.createDataFrame([(" xle", "USD"), ("XLE ", "USD")], "symbol string, currency string"))
    assert sorted(r["cache_key"] for r in wanted.collect()) == ["A", "B", "__benchmark_k__", "__sector_proxy_XLE__"]


def test_flags_targets_stats_and_reports(spark):
    rows = spark.createDataFrame([(1, "A"), (1, "B"), (2, "A")], "account_id int, ticker string")
    flags = ac.with_flags(rows, rows.limit(0), spark.createDataFrame([(1, "A"), (1, "A"), (3, "B")], rows.schema))
    assert {tuple(r) for r in flags.collect()} == {(1, "A", False, True), (1, "B", False, False), (2, "A", False, False)}
    assert [r["ticker"] for r in ac.news_targets(rows, spark.createDataFrame([("A", 1), ("C", 2)], "ticker string, n int")).collect()] == ["A"]
    report = ac.as_report(spark.createDataFrame([(1, None)], "account_id int, end_value_eur double"), "account_id", {}).first()
    assert report["report"] == '{"accountId":1,"endValueEur":null}'
    assert {tuple(r) for r in ac.table_stats({"a": (rows, "ticker"), "b": (rows.limit(0), "ticker"), "c": (rows, None)}).collect()} == {("a", 3, 3), ("b", 0, 0), ("c", 3, 0)}


def test_tables_are_replaced_in_one_step(spark, tmp_path):
    folder = str(tmp_path / "t")
    first = spark.range(3)
    assert ac.replace_table(first, folder) == 1 and ac.current_table(spark, folder).count() == 3
    reader = ac.current_table(spark, folder)
    boom = spark.range(5).select(F.raise_error(F.lit("no")).cast("long").alias("id"))
    with pytest.raises(Exception, match="no"):
        ac.replace_table(boom, folder)
    assert ac.versions(spark, folder) == [1] and ac.current_table(spark, folder).count() == 3
    number = ac.replace_table(spark.range(7), folder)
    assert ac.current_table(spark, folder).count() == 7 and reader.count() == 3
    ac.replace_table(spark.range(8), folder)
    assert ac.versions(spark, folder) == [number, number + 1]


def test_states_of_files_tell_another_table(spark, tmp_path):
    path = str(tmp_path / "x.parquet")
    spark.range(3).write.parquet(path)
    before = storage.file_states(spark, path)
    assert before == storage.file_states(spark, path) and before
    spark.range(4).write.mode("overwrite").parquet(path)
    assert storage.file_states(spark, path) != before and storage.file_states(spark, path + "none") == []


def test_lists_and_declared_fields(spark):
    rows = spark.createDataFrame([(1, "a", 3), (2, "a", 3), (3, "a", 1), (4, None, 9)], "id int, k string, n int")
    order = [F.desc("n"), F.asc("id")]
    assert [r["id"] for r in ac.listed(rows, order, k="a").collect()] == [1, 2, 3] and [r["id"] for r in ac.listed(rows, order, 2, k="a").collect()] == [1, 2]
    assert [r["id"] for r in ac.listed(rows, order, k=None).collect()] == [4] and ac.listed(rows, order).count() == 4
    overrides = spark.createDataFrame([("A", " ", ["x"]), ("B", "Energy", []), ("C", None, None)], "isin string, sector string, words array<string>")
    assert [tuple(r) for r in ac.declared(overrides, "sector").collect()] == [("B", "Energy")] and [r["isin"] for r in ac.declared(overrides, "words").collect()] == ["A"]
