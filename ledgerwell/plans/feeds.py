"""Queries over feeds, observed instruments and scans of laid-out tables, with SQL for the same results."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwell.functions.storage import new_path
from ledgerwell.operators import feeds as fd
from ledgerwell.operators import instruments as ins
from ledgerwell.plans.adapters import START, sql_views, view
from ledgerwell.sources import config as cf
from ledgerwell.sources import scans

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def _table(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Templates by the number of a feed: a fixed address, one place, and several places.
_TEMPLATES = (None, "https://x.org/q={ticker}", "https://x.org/{yahoo_ticker}/rss", "https://y.org/i/{isin}", "https://z.org/{name}?t={ticker}")
_TARGETS = "SELECT concat('T', CAST(p_partkey AS VARCHAR(20))) AS ticker, CASE WHEN p_partkey % 3 > 0 THEN concat('S+ ', CAST(p_partkey - p_partkey % 2 AS VARCHAR(20)), '~*') END AS symbol, CASE WHEN p_partkey % 4 > 0 THEN concat('US', CAST(p_partkey AS VARCHAR(20))) ELSE '' END AS isin, p_name AS name, p_partkey AS position FROM {part}"
_FEEDS_SQL = "f AS (SELECT n_nationkey AS n, concat('feed ', n_nationkey) AS feed_key, n_nationkey % 5 AS m, n_nationkey AS trust FROM nation)"
_ENCODED = "targets AS (SELECT *, url_encode(ticker) AS e_t, url_encode(nullif(symbol, '')) AS e_s, url_encode(nullif(isin, '')) AS e_i, url_encode(nullif(name, '')) AS e_n FROM ({}))".format(_TARGETS.replace("{part}", "part"))
_FILLED = "CASE m WHEN 1 THEN 'https://x.org/q=' || e_t WHEN 2 THEN 'https://x.org/' || e_s || '/rss' WHEN 3 THEN 'https://y.org/i/' || e_i ELSE 'https://z.org/' || e_n || '?t=' || e_t END"


def _targets(spark, sf_dir) -> DataFrame:
    # a target is worked on for every feed, which takes long for a file's few bytes: by files alone one task would do it all
    return spark.sql(_TARGETS, part=_table(spark, sf_dir, "part").repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey"))


def _feeds(spark, sf_dir) -> DataFrame:
    n = F.col("n_nationkey")
    template = F.element_at(F.array(*[F.lit(t) for t in _TEMPLATES]), (n % 5 + 1).cast("int"))
    tickers = F.when(n % 5 == 0, F.when(n % 10 == 0, F.array(F.concat(F.lit("T"), n.cast("string")))).otherwise(F.array(F.lit("T1"), F.lit("T2")))).when(n % 5 == 3, F.array(*[F.concat(F.lit("T"), (n + k).cast("string")) for k in range(3)]))
    url = F.when(n % 5 == 0, F.concat(F.lit("https://fixed.org/"), n.cast("string")))
    return _table(spark, sf_dir, "nation").select(F.concat(F.lit("feed "), n.cast("string")).alias("feed_key"), F.when(n == 24, "other").otherwise("rss").alias("provider"), url.alias("url"), template.alias("template"), F.coalesce(tickers, F.array().cast("array<string>")).alias("tickers"), F.array().cast("array<string>").alias("isins"), n.alias("trust"))


@query("src14_feed_requests", f"WITH {_FEEDS_SQL}, {_ENCODED}, r AS (SELECT feed_key, {_FILLED} AS url, ticker, isin, n, m FROM f JOIN targets ON m IN (1, 2, 4) OR (m = 3 AND position BETWEEN n AND n + 2)) SELECT feed_key, url, ticker, isin FROM r WHERE url IS NOT NULL UNION ALL SELECT feed_key, concat('https://fixed.org/', n), CASE WHEN n % 10 = 0 THEN concat('T', n) END, (SELECT isin FROM targets t WHERE t.position = n AND n % 10 = 0) FROM f WHERE m = 0")
def feed_requests(spark, sf_dir):
    return fd.plan(_feeds(spark, sf_dir), _targets(spark, sf_dir))[0].select("feed_key", "url", "ticker", "isin")


@query("src14_feed_notes", f"WITH {_FEEDS_SQL}, {_ENCODED} SELECT feed_key, ticker, 'needs a field that the instrument does not have' AS note FROM f JOIN targets ON m IN (1, 2, 4) OR (m = 3 AND position BETWEEN n AND n + 2) WHERE {_FILLED} IS NULL UNION ALL SELECT feed_key, NULL, 'several instruments with a fixed url: its items are market-wide' FROM f WHERE m = 0 AND n % 10 <> 0")
def feed_notes(spark, sf_dir):
    return fd.plan(_feeds(spark, sf_dir), _targets(spark, sf_dir))[1]


_RAW = "raw AS (SELECT p_partkey AS raw_id, CASE WHEN p_partkey % 11 = 0 THEN 'gone' ELSE concat('feed ', p_partkey % 25) END AS feed_key, CASE WHEN p_partkey % 7 = 0 THEN 'https://x.org/q=nobody' ELSE coalesce(CASE WHEN p_partkey % 5 = 0 THEN 'https://any.org' ELSE {filled} END, 'https://none.org') END AS url FROM part JOIN targets ON position = p_partkey JOIN f ON n = p_partkey % 25)"


@query("join16_traced_addresses", f"WITH {_FEEDS_SQL}, {_ENCODED}, {_RAW.format(filled=_FILLED)}, idx AS (SELECT feed_key, {_FILLED} AS url, max_by(ticker, position) AS ticker, max_by(isin, position) AS isin FROM f JOIN targets ON m > 0 GROUP BY ALL) SELECT raw_id, CASE WHEN m = 0 AND n % 10 = 0 THEN concat('T', n) WHEN m > 0 AND n <> 24 THEN i.ticker END AS ticker, CASE WHEN n = 24 THEN NULL WHEN m = 0 THEN (SELECT isin FROM targets t WHERE t.position = n AND n % 10 = 0) ELSE i.isin END AS isin, CASE WHEN f.n IS NULL THEN '{fd.NO_FEED}' WHEN f.n = 24 THEN 'no adapter for provider ''other''' WHEN m > 0 AND i.ticker IS NULL THEN '{fd.NO_TARGET.replace(chr(39), chr(39) * 2)}' END AS skip FROM raw LEFT JOIN f USING (feed_key) LEFT JOIN idx i ON i.feed_key = raw.feed_key AND i.url = raw.url")
def traced_addresses(spark, sf_dir):
    feeds, targets = _feeds(spark, sf_dir), _targets(spark, sf_dir)
    own = targets.withColumn("n", F.col("position") % 25).withColumn("template", F.element_at(F.array(*[F.lit(t) for t in _TEMPLATES]), (F.col("position") % 5 + 1).cast("int")))
    url = F.when(F.col("position") % 7 == 0, "https://x.org/q=nobody").when(F.col("position") % 5 == 0, "https://any.org").otherwise(F.coalesce(fd.filled(F.col("template"), {c: F.col(c) for c in ("ticker", "symbol", "isin", "name")}), F.lit("https://none.org")))
    raw = own.select(F.col("position").alias("raw_id"), F.when(F.col("position") % 11 == 0, "gone").otherwise(F.concat(F.lit("feed "), F.col("n").cast("string"))).alias("feed_key"), url.alias("url"))
    return fd.attributed(raw, feeds, targets, ("rss",)).select("raw_id", "ticker", "isin", "skip")


_SEEN = {
    "positions": "SELECT concat('T', CAST(p_partkey - p_partkey % 4 AS VARCHAR(20))) AS ticker, p_partkey AS seen, CASE WHEN p_partkey % 3 = 0 THEN concat('P', CAST(p_partkey AS VARCHAR(20))) ELSE '' END AS isin, CASE WHEN p_partkey % 5 = 0 THEN p_name END AS name, CASE WHEN p_partkey % 8 = 1 THEN 'USD' END AS currency, CAST(NULL AS VARCHAR(9)) AS instrument_type FROM {part} WHERE p_partkey % 3 < 2",
    "orders": "SELECT CASE WHEN o_custkey % 9 > 0 THEN concat('T', CAST(o_custkey - o_custkey % 4 AS VARCHAR(20))) END AS ticker, o_orderkey AS seen, CASE WHEN o_orderkey % 4 = 0 THEN concat('O', CAST(o_orderkey AS VARCHAR(20))) END AS isin, CASE WHEN o_orderkey % 3 = 0 THEN concat('order ', CAST(o_orderkey AS VARCHAR(20))) END AS name, CASE WHEN o_orderkey % 2 = 0 THEN 'EUR' ELSE '' END AS currency, CAST(NULL AS VARCHAR(9)) AS instrument_type FROM {orders}",
    "dividends": "SELECT concat('T', CAST(s_suppkey * 4 AS VARCHAR(20))) AS ticker, s_suppkey AS seen, 'D' AS isin, s_name AS name, 'GBX' AS currency, CAST(NULL AS VARCHAR(9)) AS instrument_type FROM {supplier}",
}
_META = "SELECT concat('T', CAST(c_custkey AS VARCHAR(20))) AS ticker, CASE WHEN c_custkey % 2 = 0 THEN concat('M', CAST(c_custkey AS VARCHAR(20))) END AS isin, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN 'USD' ELSE 'EUR' END AS currency, 'STOCK' AS instrument_type FROM {customer} WHERE c_custkey % 4 = 0 AND c_custkey % 3 < 2 OR c_custkey % 4 = 1"
_CACHED = "SELECT concat('T', CAST(c_custkey AS VARCHAR(20))) AS ticker, concat('C', CAST(c_custkey AS VARCHAR(20))) AS isin, 'cached' AS name, 'CHF' AS currency, 'ETF' AS instrument_type FROM {customer} WHERE c_custkey % 8 = 0"
_PLAIN = lambda sql: sql.replace("{", "").replace("}", "")
_OBSERVED = "s AS ({}), o AS (SELECT ticker, {} FROM s WHERE ticker IS NOT NULL GROUP BY ticker)".format(
    " UNION ALL ".join(f"SELECT {i} AS source, * FROM ({_PLAIN(sql)})" for i, sql in enumerate(_SEEN.values())), ", ".join(f"arg_min({c}, (source, seen)) FILTER (nullif({c}, '') IS NOT NULL) AS {c}" for c in ins.FIELDS)
)


def _sources(spark, sf_dir) -> list[DataFrame]:
    tables = {"positions": "part", "orders": "orders", "dividends": "supplier"}
    return [spark.sql(sql, **{tables[k]: _table(spark, sf_dir, tables[k])}) for k, sql in _SEEN.items()]


@query("flt13_observed_instruments", f"WITH {_OBSERVED} SELECT * FROM o")
def observed_instruments(spark, sf_dir):
    return ins.observed(*_sources(spark, sf_dir))


_RICH = f"m AS ({_PLAIN(_META)}), c AS ({_PLAIN(_CACHED)}), e AS (SELECT ticker, {', '.join(f'coalesce(o.{c}, m.{c}, c.{c}) AS {c}' for c in ins.FIELDS)} FROM o LEFT JOIN m USING (ticker) LEFT JOIN c USING (ticker))"


def _enriched(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    meta = spark.sql(_META, customer=_table(spark, sf_dir, "customer"))
    return ins.enriched(ins.observed(*_sources(spark, sf_dir)), meta, spark.sql(_CACHED, customer=_table(spark, sf_dir, "customer"))), meta


@query("join23_enriched_instruments", f"WITH {_OBSERVED}, {_RICH} SELECT * FROM e")
def enriched_instruments(spark, sf_dir):
    return _enriched(spark, sf_dir)[0]


_CASES = "SELECT p_partkey AS n, concat('T', CAST(p_partkey AS VARCHAR(20))) AS ticker, CASE WHEN p_partkey % 17 > 0 THEN concat('I', CAST(p_partkey AS VARCHAR(20))) END AS isin, CASE p_partkey % 3 WHEN 0 THEN 'GBX' ELSE 'usd' END AS currency FROM {part}"
_RESOLVED = """CASE WHEN isin IS NULL OR (n % 13 > 0 AND (n % 10 > 7 OR n % 10 = 7)) THEN 'unresolved' WHEN n % 13 = 0 THEN 'resolved' WHEN n % 3 = 0 THEN 'override_required'
 WHEN n % 10 < 2 THEN 'resolved' WHEN n % 10 < 5 THEN 'ambiguous' WHEN n % 10 = 5 THEN 'override_required' ELSE 'unresolved' END"""


@query("src20_resolved_symbols", f"WITH r AS ({_PLAIN(_CASES)}), x AS (SELECT *, {_RESOLVED} AS status FROM r) SELECT ticker, status, CASE WHEN isin IS NULL THEN 'missing_isin' WHEN n % 13 = 0 THEN 'override' ELSE 'service' END AS source, CASE WHEN isin IS NULL OR status <> 'resolved' THEN NULL WHEN n % 13 = 0 THEN concat('OV', n) ELSE concat('BRK-', n) END AS symbol, CASE WHEN isin IS NULL OR n % 13 = 0 OR n % 10 >= 7 THEN 0 WHEN n % 10 = 6 THEN 1 ELSE 2 END AS candidates FROM x")
def resolved_symbols(spark, sf_dir):
    r = spark.sql(_CASES, part=_table(spark, sf_dir, "part"))
    text = F.concat(F.lit("BRK."), F.col("n").cast("string"))
    one = lambda ticker, exchange: F.struct(ticker.alias("ticker"), exchange.alias("exchange"))
    k, other, null = F.col("n") % 10, F.lit("OTHER"), F.lit(None).cast("string")
    candidates = (
        F.when(k == 0, F.array(one(text, F.lit("UW")), one(text, F.lit("UN")))).when(k == 1, F.array(one(text, F.lit("US")), one(other, F.lit("LN")))).when(k == 2, F.array(one(text, F.lit("US")), one(other, F.lit("UQ"))))
        .when(k < 5, F.array(one(text, F.lit("GR")), one(other, F.lit("LN")))).when(k == 5, F.array(one(text, F.lit("GR")), one(text, null))).when(k == 6, F.array(one(text, null)))
    )
    answers = r.filter("isin is not null and n % 10 < 9").select("isin", F.when(k == 8, "http_429").alias("error"), candidates.alias("candidates"))
    overrides = r.filter("n % 13 = 0 and isin is not null").select("isin", F.concat(F.lit("OV"), F.col("n").cast("string")).alias("symbol"))
    return ins.resolved(r.select("ticker", "isin", "currency"), overrides, answers)


@query("prj20_instrument_seeds", f"WITH {_OBSERVED}, {_RICH} SELECT coalesce(e.ticker, m.ticker) AS ticker, {', '.join(f'CASE WHEN m.ticker IS NULL THEN e.{c} ELSE m.{c} END AS {c}' for c in ins.FIELDS)}, e.ticker IS NOT NULL AS observed, CASE WHEN e.ticker IS NULL THEN 'not_required' WHEN e.isin LIKE 'O%' THEN 'resolved' ELSE 'unresolved' END AS status, CASE WHEN e.ticker IS NULL THEN NULL WHEN e.isin IS NULL THEN 'missing_isin' WHEN e.isin LIKE 'O%' THEN 'override' ELSE 'service' END AS source, CASE WHEN e.isin LIKE 'O%' THEN lower(e.isin) END AS symbol FROM e FULL JOIN m USING (ticker)")
def instrument_seeds(spark, sf_dir):
    seen, meta = _enriched(spark, sf_dir)
    overrides = seen.filter("isin like 'O%'").select("isin", F.lower("isin").alias("symbol")).distinct()
    no_answers = spark.createDataFrame([], "isin string, error string, candidates array<struct<ticker:string,exchange:string>>")
    return ins.seeds(seen, meta, ins.resolved(seen, overrides, no_answers))


def _price_table(spark, sf_dir) -> str:
    name = f"prices_{uuid.uuid4().hex}"
    scans.write_daily(view(spark, sf_dir, "v_prices"), name, "ticker", "price_date", new_path(spark, "prices"))
    return name


@query("src21_prices_between", f"WITH {sql_views('v_prices')} SELECT ticker, strftime(price_date, '%Y-%m-%d') AS price_date, CAST(close_price AS DOUBLE) AS close_price FROM v_prices WHERE price_date BETWEEN DATE '1996-02-10' AND DATE '1996-06-03'")
def prices_between(spark, sf_dir):
    rows = scans.between(spark, _price_table(spark, sf_dir), "price_date", "1996-02-10", "1996-06-03")
    return rows.select("ticker", F.date_format("price_date", "yyyy-MM-dd").alias("price_date"), F.col("close_price").cast("double").alias("close_price"))


@query("src22_prices_of_ticker", f"WITH {sql_views('v_prices')} SELECT ticker, count(*) AS days, CAST(max(close_price) AS DOUBLE) AS highest, strftime(min(price_date), '%Y-%m-%d') AS first_day FROM v_prices WHERE ticker IN ('Brand#12', 'Brand#33') AND price_date >= DATE '{START}' GROUP BY ticker")
def prices_of_ticker(spark, sf_dir):
    rows = scans.of_keys(spark, _price_table(spark, sf_dir), "ticker", "Brand#12", "Brand#33").filter(F.col("price_date") >= F.lit(START).cast("date"))
    return rows.groupBy("ticker").agg(F.count("*").alias("days"), F.max("close_price").cast("double").alias("highest"), F.date_format(F.min("price_date"), "yyyy-MM-dd").alias("first_day"))


@query("src15_feed_entries", """WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 50 = 7 THEN concat('twice ', c_custkey // 100) ELSE concat('feed ', c_custkey) END AS key FROM customer), n AS (SELECT key, count(*) AS n FROM c GROUP BY key)
SELECT k, CASE k % 9 WHEN 0 THEN 'unknown field colour' WHEN 1 THEN 'label is of another type' WHEN 2 THEN 'needs exactly one of url and url_template' WHEN 3 THEN 'url must be http or https' WHEN 4 THEN 'url_template must contain a placeholder' ELSE CASE WHEN n > 1 THEN 'key is there more than once' END END AS fault FROM c JOIN n USING (key)""")
def feed_entries(spark, sf_dir):
    k = F.col("c_custkey")
    line = lambda name, value: F.concat(F.lit(f"    {name}: "), value, F.lit("\n"))
    address = F.when(k % 9 == 2, "").when(k % 9 == 3, line("url", F.lit("ftp://x"))).when(k % 9 == 4, line("url_template", F.lit("https://x/none"))).when(k % 9 < 7, line("url_template", F.lit("'https://x/{ticker}'"))).otherwise(line("url", F.lit("https://x")))
    key = F.when(k % 50 == 7, F.concat(F.lit("twice "), F.expr("c_custkey div 100").cast("string"))).otherwise(F.concat(F.lit("feed "), k.cast("string")))
    entry = F.concat(F.lit("  - key: "), key, F.lit("\n"), line("label", F.when(k % 9 == 1, "12").otherwise("Name")), line("user_agent", F.concat(F.lit("no "), k.cast("string"))), address, F.when(k % 9 == 0, line("colour", F.lit("red"))).otherwise(""))
    files = _table(spark, sf_dir, "customer").groupBy(F.expr("c_custkey div 100").alias("chunk")).agg(F.concat(F.lit("feeds:\n"), F.array_join(F.array_sort(F.collect_list(entry)), "")).alias("value"))
    path = new_path(spark, "feeds")
    files.write.partitionBy("chunk").text(path)
    rows = cf.judged(cf.read_entries(spark, path, "feeds"), "feeds")
    return rows.select(F.substring_index("user_agent", " ", -1).cast("long").alias("k"), "fault")
