"""Queries over sources and tables that are written to: texts are made from the driver's tables, read back, and compared."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwell.functions.storage import new_path
from ledgerwell.operators import requests as rq
from ledgerwell.sources import raw, tables
from ledgerwell.plans.adapters import sql_views, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def _written(df: DataFrame, name: str) -> str:
    path = new_path(df.sparkSession, name)
    df.write.option("header", True).option("escape", '"').csv(path)
    return path


def _table(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("src04_export_rows", "SELECT CAST(event_id AS VARCHAR) AS row_id, event_type AS action, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, CASE WHEN event_id % 3 <> 0 THEN round(value, 2) END AS total FROM events WHERE event_id % 5 <> 0")
def export_rows(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    out = e.select(
        F.col("event_type").alias("Action"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("Time"), F.when(F.col("event_id") % 5 == 0, "ABC").otherwise("").alias("Ticker"),
        F.when(F.col("event_id") % 3 == 0, "n/a, \"none\"").otherwise(F.format_string("%.2f", F.round("value", 2))).alias("Total"), F.col("event_id").cast("string").alias("ID"), F.lit("line\nbreak").alias("Notes"),
    )
    rows = raw.read_export(spark, _written(out, "export"))
    return rows.select("row_id", "action", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.col("total").cast("double").alias("total"))


@query("src09_exchange_rates", f"WITH {sql_views('v_fx')} SELECT currency, rate_date, round(1 / CAST(eur_per_unit AS DOUBLE), 9) AS eur_per_unit FROM v_fx WHERE day(rate_date) <> 13")
def exchange_rates(spark, sf_dir):
    fx = view(spark, sf_dir, "v_fx").select(F.lower("currency").alias("CURRENCY"), F.col("rate_date").cast("string").alias("TIME_PERIOD"), F.when(F.dayofmonth("rate_date") == 13, "0").otherwise(F.col("eur_per_unit").cast("string")).alias("OBS_VALUE"))
    return raw.read_rates(spark, _written(fx, "rates")).select("currency", "rate_date", F.round("eur_per_unit", 9).alias("eur_per_unit"))


@query("src16_earnings_calendar", "SELECT CAST(o_custkey AS VARCHAR) AS symbol, CAST(o_orderdate AS DATE) AS report_date, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderkey % 100 AS DOUBLE) END AS estimate_eps, CASE WHEN o_orderkey % 3 = 0 THEN 'pre-market' END AS time_of_day FROM orders WHERE o_orderkey % 7 <> 0")
def earnings_calendar(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("symbol"), F.when(F.col("o_orderkey") % 7 == 0, "None").otherwise(F.col("o_orderdate").cast("date").cast("string")).alias("reportDate"), F.lit("2024-03-31").alias("fiscalDateEnding"),
        F.when(F.col("o_orderkey") % 4 == 0, "-").otherwise((F.col("o_orderkey") % 100).cast("string")).alias("estimate"), F.lit("USD").alias("currency"), F.when(F.col("o_orderkey") % 3 == 0, "Pre-Market").otherwise("").alias("timeOfTheDay"),
    )
    return raw.read_earnings(spark, _written(o, "earnings")).select("symbol", "report_date", F.col("estimate_eps").cast("double").alias("estimate_eps"), "time_of_day")


@query("src17_declared_dividends", "SELECT o_custkey AS symbol, CAST(o_orderdate AS DATE) AS ex_date, CAST(o_orderkey % 9 AS DOUBLE) AS amount FROM orders WHERE o_orderkey % 9 > 0")
def declared_dividends(spark, sf_dir):
    item = F.struct(F.col("o_orderdate").cast("date").cast("string").alias("ex_dividend_date"), F.lit("None").alias("payment_date"), (F.col("o_orderkey") % 9).cast("string").alias("amount"))
    bodies = _table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("symbol")).agg(F.to_json(F.struct(F.collect_list(item).alias("data"))).alias("body"))
    return raw.declared_dividends(bodies, "body").select("symbol", "ex_date", F.col("amount").cast("double").alias("amount"))


@query("src18_company_facts", "WITH f AS (SELECT o_custkey, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS s, CAST(o_orderkey AS DOUBLE) AS v, CAST(o_orderdate AS DATE) AS filed FROM orders) SELECT o_custkey, 'Revenues' AS concept, s AS start_date, arg_max(v, (filed, v)) AS val FROM f GROUP BY o_custkey, s")
def company_facts(spark, sf_dir):
    o, day = _table(spark, sf_dir, "orders"), F.trunc("o_orderdate", "quarter")
    fact = F.struct(day.cast("string").alias("start"), F.add_months(day, 3).cast("string").alias("end"), F.col("o_orderkey").cast("double").alias("val"), F.col("o_orderdate").cast("date").cast("string").alias("filed"))
    rows = o.groupBy("o_custkey").agg(F.collect_list(fact).alias("rows"))
    units = lambda x: F.struct(F.struct(x.alias("USD")).alias("units"))
    body = F.to_json(F.struct(F.struct(F.struct(units(F.col("rows")).alias("Revenues"), units(F.slice("rows", 1, 0)).alias("SalesRevenueNet")).alias("us-gaap")).alias("facts")))
    out = raw.company_facts(rows.select("o_custkey", body.alias("body")), "body", ("SalesRevenueNet", "Revenues"))
    return out.select("o_custkey", "concept", F.col("start").alias("start_date"), "val")


@query("src12_feed_items", f"WITH {sql_views('v_news')} SELECT company_id, headline, published FROM v_news WHERE news_id % 9 <> 0")
def feed_items(spark, sf_dir):
    n = view(spark, sf_dir, "v_news")
    safe = lambda c: F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    link = F.when(F.col("news_id") % 9 == 0, "ftp://x").otherwise(F.concat(F.lit("https://x.org/?a=1&amp;id="), F.col("news_id").cast("string")))
    item = F.concat(F.lit("<item><title>"), safe("headline"), F.lit("</title><link>"), link, F.lit("</link>"), F.coalesce(F.concat(F.lit("<pubDate>"), "published", F.lit("</pubDate>")), F.lit("")), F.lit("</item>"))
    bodies = n.groupBy("company_id", F.expr("news_id div 1000").alias("chunk")).agg(F.concat(F.lit("<?xml version='1.0'?><rss><channel><title>T</title>"), F.array_join(F.collect_list(item), ""), F.lit("</channel></rss>")).alias("body"))
    return raw.feed_items(bodies, "body", 100_000).select("company_id", "headline", "published")


_OLD = "SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_custkey % 3 <> 0"


@query("snk05_upsert", f"WITH a AS ({_OLD}), b AS (SELECT o_custkey AS k, CAST(arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS DOUBLE) AS v FROM orders WHERE o_custkey % 2 = 0 GROUP BY ALL) SELECT * FROM b UNION ALL SELECT * FROM a WHERE k NOT IN (SELECT k FROM b)")
def upsert(spark, sf_dir):
    old = _table(spark, sf_dir, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    new = _table(spark, sf_dir, "orders").filter("o_custkey % 2 = 0").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").cast("double").alias("v"), F.struct("o_orderdate", "o_orderkey").alias("seen"))
    return tables.upsert(old.withColumn("seen", F.lit(None).cast(new.schema["seen"].dataType)), new, ["k"], "seen").drop("seen")


@query("snk04_insert_ignore", f"WITH a AS (SELECT concat('c:', CAST(k AS VARCHAR)) AS key FROM ({_OLD})) SELECT key FROM a UNION SELECT DISTINCT concat('c:', CAST(o_custkey AS VARCHAR)) FROM orders")
def insert_ignore(spark, sf_dir):
    key = lambda c: F.concat(F.lit("c:"), F.col(c).cast("string")).alias("key")
    return tables.insert_new(_table(spark, sf_dir, "customer").filter("c_custkey % 3 <> 0").select(key("c_custkey")), _table(spark, sf_dir, "orders").select(key("o_custkey")), "key")


@query("snk02_fill_in", "WITH a AS (SELECT c_custkey AS k, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'resolved' ELSE 'pending' END AS status FROM customer WHERE c_custkey % 5 <> 0), b AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN upper(c_name) END AS name, 'failed' AS status FROM customer WHERE c_custkey % 4 <> 0) SELECT coalesce(a.k, b.k) AS k, coalesce(b.name, a.name) AS name, CASE WHEN a.status = 'resolved' THEN a.status ELSE coalesce(b.status, a.status) END AS status FROM a FULL JOIN b ON a.k = b.k")
def fill_in(spark, sf_dir):
    c = _table(spark, sf_dir, "customer").withColumn("k", F.col("c_custkey"))
    old = c.filter("k % 5 <> 0").select("k", F.col("c_name").alias("name"), F.when(F.col("k") % 2 == 0, "resolved").otherwise("pending").alias("status"))
    return tables.fill_in(old, c.filter("k % 4 <> 0").select("k", F.when(F.col("k") % 3 == 0, F.upper("c_name")).alias("name"), F.lit("failed").alias("status")), ["k"], ["name"], "status")


@query("snk06_replace_future", "WITH a AS (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS day, o_orderkey AS v FROM orders), b AS (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) + 1000 AS day, -o_orderkey AS v FROM orders WHERE o_custkey % 4 = 0 AND o_orderkey % 5 = 0) SELECT * FROM b UNION ALL SELECT * FROM a WHERE NOT (day >= DATE '1997-01-01' AND k IN (SELECT k FROM b))")
def replace_future(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").cast("date").alias("day"), F.col("o_orderkey").alias("v"))
    new = o.filter("k % 4 = 0 and v % 5 = 0").select("k", F.date_add("day", 1000).alias("day"), (-F.col("v")).alias("v"))
    return tables.replace_future(o, new, "k", "day", "1997-01-01")


@query("snk09_calendar_entries", "SELECT concat('e:', CAST(o_orderkey AS VARCHAR)) AS id, CAST(o_orderdate AS DATE) AS day, concat('BEGIN:VEVENT', chr(13), chr(10), 'UID:e-', CAST(o_orderkey AS VARCHAR), '@ledgerwell.local', chr(13), chr(10), 'DTSTAMP:20240101T000000Z', chr(13), chr(10), 'DTSTART;VALUE=DATE:', strftime(CAST(o_orderdate AS DATE), '%Y%m%d'), chr(13), chr(10), 'DTEND;VALUE=DATE:', strftime(CAST(o_orderdate AS DATE) + 1, '%Y%m%d'), chr(13), chr(10), 'SUMMARY:A\\; B\\, ', CAST(o_custkey AS VARCHAR), chr(13), chr(10), 'DESCRIPTION:one\\ntwo', chr(13), chr(10), 'TRANSP:TRANSPARENT', chr(13), chr(10), 'END:VEVENT') AS entry FROM orders")
def calendar_entries(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    events = o.select(F.concat(F.lit("e:"), F.col("o_orderkey").cast("string")).alias("id"), F.col("o_orderdate").cast("date").alias("day"), F.concat(F.lit("A; B, "), F.col("o_custkey").cast("string")).alias("summary"), F.lit("one\ntwo").alias("description"))
    return tables.calendar_entries(events, "20240101T000000Z")


@query("src13_service_items", f"WITH {sql_views('v_news')} SELECT company_id, trim(headline) AS headline, CASE WHEN news_id % 2 = 0 THEN 'said' ELSE 'cut' END AS summary, published FROM v_news WHERE news_id % 9 <> 0 AND news_id % 8 <> 0")
def service_items(spark, sf_dir):
    n = view(spark, sf_dir, "v_news")
    link = F.when(F.col("news_id") % 9 == 0, "ftp://x").otherwise(F.concat(F.lit("HTTPS://x.org/"), F.col("news_id").cast("string")))
    item = F.struct(F.when(F.col("news_id") % 8 != 0, F.concat(F.col("headline"), F.lit(" "))).alias("title"), link.alias("url"), F.when(F.col("news_id") % 2 == 0, "said").otherwise("").alias("description"), F.lit("cut").alias("snippet"), F.col("published").alias("published_at"))
    bodies = n.groupBy("company_id", F.expr("news_id div 1000").alias("chunk")).agg(F.to_json(F.struct(F.collect_list(item).alias("data"))).alias("body"))
    return raw.news_items(bodies, "body", 100_000).select("company_id", "headline", "summary", "published")


def _zipped(text: str):
    @F.pandas_udf("binary")
    def pack(texts: pd.Series) -> pd.Series:
        def one(t):
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w") as archive:
                archive.writestr("daily.csv", t)
            return out.getvalue()

        return texts.map(one)

    return pack(F.col(text))


@query("src11_factor_days", "WITH d AS (SELECT CAST(o_orderdate AS DATE) AS as_of, count(*) AS n FROM orders GROUP BY ALL) SELECT as_of, round(n / 100.0, 6) AS mkt_rf, round(-n / 200.0, 6) AS smb, round(n / 1000.0, 6) AS mom, CAST(0.0001 AS DOUBLE) AS risk_free FROM d WHERE day(as_of) <> 13 AND day(as_of) <> 14")
def factor_days(spark, sf_dir):
    d = _table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("as_of")).agg(F.count("*").alias("n"))
    n, day = F.col("n").cast("double"), F.date_format("as_of", "yyyyMMdd")
    five = F.concat_ws(",", day, n.cast("string"), F.when(F.dayofmonth("as_of") == 13, "-99.99").otherwise((-n / 2).cast("string")), F.lit("1"), F.lit("1"), F.lit("1"), F.lit("0.01"))
    momentum = F.when(F.dayofmonth("as_of") != 14, F.concat_ws(",", day, (n / 10).cast("string")))
    file = lambda names, line: F.concat(F.lit(f"Some prose, about it\n\n,{names}\n"), F.array_join(F.array_sort(F.collect_list(line)), "\n"), F.lit("\n\nCopyright\n20200101,9,9,9,9,9,9\n"))
    # One small file a year, as published files are; each is unzipped and read on its own.
    files = d.groupBy(F.year("as_of").alias("year")).agg(file("Mkt-RF,SMB,HML,RMW,CMA,RF", five).alias("five"), file("Mom", momentum).alias("mom"))
    rows = lambda c: raw.factor_rows(files.select("year", _zipped(c).alias("body")), "body")
    return raw.factor_days(rows("five"), rows("mom")).select("as_of", *[F.round(c, 6).alias(c) for c in ("mkt_rf", "smb", "mom", "risk_free")])


_REPORTED = "x AS (SELECT l_suppkey % 20 AS fund, l_orderkey, l_linenumber, p_brand AS name, CAST(l_tax AS DOUBLE) AS pct, CASE WHEN l_linenumber = 3 THEN 'Other' ELSE p_type END AS country, CASE WHEN p_brand LIKE '%1' THEN NULL ELSE concat('L', p_brand) END AS lei FROM lineitem JOIN part ON l_partkey = p_partkey)"


def _reports(spark, sf_dir) -> DataFrame:
    x = _table(spark, sf_dir, "lineitem").join(_table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>"))
    lei = F.when(F.col("p_brand").endswith("1"), "").otherwise(F.concat(F.lit("L"), "p_brand"))
    country = F.when(F.col("l_linenumber") == 3, "").otherwise(F.col("p_type"))
    item = F.concat(F.lit("<invstOrSec>"), tag("name", F.col("p_brand")), tag("lei", lei), tag("cusip", F.lit("000000000")), tag("pctVal", F.col("l_tax").cast("string")), tag("invCountry", country), F.lit('<identifiers><isin value="US1"/></identifiers></invstOrSec>'))
    head = F.lit('<?xml version="1.0"?><edgarSubmission xmlns="http://www.sec.gov/edgar/nport"><formData><genInfo><repPdDate>2024-03-31</repPdDate></genInfo><invstOrSecs>')
    # a fund reports in parts of bounded size
    return x.groupBy((F.col("l_suppkey") % 20).alias("fund"), F.expr("l_orderkey div 4096").alias("part")).agg(F.concat(head, F.array_join(F.collect_list(item), ""), F.lit("</invstOrSecs></formData></edgarSubmission>")).alias("body"))


@query("src19_fund_holdings", f"WITH {_REPORTED} SELECT fund, coalesce(lei, name) AS issuer, name, DATE '2024-03-31' AS report_date, 'US1' AS isin, round(sum(pct), 6) AS pct FROM x GROUP BY ALL")
def fund_holdings(spark, sf_dir):
    parts = raw.fund_holdings(_reports(spark, sf_dir), "body")
    return parts.groupBy("fund", "issuer", "name", "report_date", "isin").agg(F.round(F.sum("pct"), 6).alias("pct"))


@query("src19_fund_countries", f"WITH {_REPORTED} SELECT fund, country, round(sum(pct), 6) AS pct, count(*) AS holdings FROM x GROUP BY ALL")
def fund_countries(spark, sf_dir):
    parts = raw.fund_countries(_reports(spark, sf_dir), "body")
    return parts.groupBy("fund", "country").agg(F.round(F.sum("pct"), 6).alias("pct"), F.sum("holdings").alias("holdings"))


@query("prj07_provider_symbols", "WITH s AS (SELECT p_partkey, concat(p_brand, CASE p_partkey % 5 WHEN 0 THEN '.L' WHEN 1 THEN '.de' WHEN 2 THEN '.XX' WHEN 3 THEN '-B' ELSE '' END) AS s, replace(p_brand, '.', '') AS b, p_partkey % 5 AS m FROM part) SELECT p_partkey, CASE m WHEN 0 THEN b ELSE s END AS plain, CASE m WHEN 0 THEN 'LSE' END AS plain_exchange, CASE m WHEN 0 THEN b || '.LON' ELSE s END AS suffixed, CASE m WHEN 0 THEN b || '.LSE' WHEN 1 THEN b || '.XETRA' WHEN 2 THEN NULL ELSE s || '.US' END AS coded FROM s")
def provider_symbols(spark, sf_dir):
    suffix = F.expr("CASE p_partkey % 5 WHEN 0 THEN '.L' WHEN 1 THEN '.de' WHEN 2 THEN '.XX' WHEN 3 THEN '-B' ELSE '' END")
    return _table(spark, sf_dir, "part").select("p_partkey", rq.provider_symbols(F.concat("p_brand", suffix)).alias("s")).select("p_partkey", "s.*")


_STORED = "SELECT event_id, CASE event_id % 6 WHEN 0 THEN '/equity/positions' WHEN 1 THEN '/equity/history/orders?cursor=5' WHEN 2 THEN 'https://h.org/api/v0/equity/history/dividends' WHEN 3 THEN '/api/v0/equity/metadata/instruments#x' WHEN 4 THEN '/equity/history/transactions' ELSE '/equity/pies' END AS endpoint, CASE WHEN event_id % 7 = 0 THEN 429 ELSE 200 + event_id % 3 END AS status"


def _stored(spark, sf_dir) -> DataFrame:
    return spark.sql(_STORED + " FROM {events}", events=_table(spark, sf_dir, "events")).withColumn("c", rq.classified_endpoint(F.col("endpoint")))


_KINDS = "c AS (SELECT *, CASE event_id % 6 WHEN 0 THEN 'positions' WHEN 1 THEN 'orders' WHEN 2 THEN 'dividends' WHEN 3 THEN 'metadata' WHEN 4 THEN 'transactions' ELSE 'unknown' END AS category FROM s)"


@query("prj15_classified_endpoints", f"WITH s AS ({_STORED} FROM events), {_KINDS} SELECT event_id, category, CASE category WHEN 'metadata' THEN '/equity/metadata/instruments' WHEN 'positions' THEN '/equity/positions' WHEN 'unknown' THEN '/equity/pies' ELSE '/equity/history/' || category END AS path FROM c")
def classified_endpoints(spark, sf_dir):
    return _stored(spark, sf_dir).select("event_id", "c.category", "c.path")


@query("flt11_replay_skips", f"WITH s AS ({_STORED} FROM events), {_KINDS} SELECT category, CASE WHEN status >= 300 THEN 'non-2xx response (status 429)' WHEN category = 'positions' THEN 'live-state endpoint (current positions); not history, so it is not replayed' WHEN category = 'unknown' THEN 'unsupported or unrecognised endpoint for replay' END AS reason, count(*) AS n FROM c GROUP BY ALL")
def replay_skips(spark, sf_dir):
    s = _stored(spark, sf_dir).select("c.category", rq.replay_skips(F.col("c.category"), F.col("status")).alias("reason"))
    return s.groupBy("category", "reason").agg(F.count("*").alias("n"))


@query("prj24_redacted_messages", "SELECT event_id, concat(CASE event_id % 3 WHEN 0 THEN 'your API key as [redacted]' WHEN 1 THEN 'apikey=[redacted]' ELSE 'api-key: short' END, '. Wait') AS message FROM events")
def redacted_messages(spark, sf_dir):
    text = F.expr("concat(CASE event_id % 3 WHEN 0 THEN concat('your API key as ABCD', lpad(CAST(event_id AS STRING), 8, '0')) WHEN 1 THEN 'apikey=abc_DEF-99' ELSE 'api-key: short' END, '. Wait')")
    return _table(spark, sf_dir, "events").select("event_id", rq.redacted(text).alias("message"))


@query("agg40_quality_report", "WITH e AS (SELECT user_id AS account, count(*) FILTER (event_type = 'error') AS failed, bool_or(event_type = 'signup') AS fresh FROM events GROUP BY ALL), i AS (SELECT c_custkey AS account, count(*) FILTER (c_mktsegment = 'BUILDING') AS unready FROM customer GROUP BY ALL), p AS (SELECT o_custkey AS account, count(*) FILTER (o_orderkey % 40 = 0) AS unbalanced FROM orders GROUP BY ALL) SELECT account, CASE WHEN failed > 0 THEN 'ERROR' WHEN NOT fresh OR coalesce(unready, 0) + coalesce(unbalanced, 0) > 0 THEN 'WARNING' ELSE 'OK' END AS overall, failed, coalesce(unready, 0) AS unready, coalesce(unbalanced, 0) AS unbalanced FROM e LEFT JOIN i USING (account) LEFT JOIN p USING (account)")
def quality_report(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select(F.col("user_id").alias("account"), F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("last_status"), (F.col("event_type") == "signup").alias("fresh"))
    i = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("account"), F.when(F.col("c_mktsegment") == "BUILDING", "ambiguous").otherwise("resolved").alias("status"))
    p = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("account"), F.when(F.col("o_orderkey") % 40 == 0, "MISMATCH").otherwise("MATCHED").alias("status"))
    return rq.overall_status(e, i, p, F.col("fresh"), "account")
