"""Queries over what an account's pages list, with SQL for the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwell.functions.money import MONEY
from ledgerwell.functions.storage import new_path
from ledgerwell.operators import accounts as ac
from ledgerwell.operators import agenda as ag
from ledgerwell.operators import periods as pd_
from ledgerwell.operators import returns as rt
from ledgerwell.plans.feeds import _PLAIN, _TARGETS
from ledgerwell.plans.messages import _POSITIONS, _WATCH
from ledgerwell.plans.portfolio import NAV, r, replayed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def _sql(spark, sf_dir, text: str) -> DataFrame:
    """A text over one table, named in braces."""
    name = text.split("{")[1].split("}")[0]
    return spark.sql(text, **{name: spark.read.parquet(f"{sf_dir}/{name}.parquet")})


_OLD = "SELECT o_custkey AS account_id, concat('K', CAST(o_orderkey % 5 AS VARCHAR(9))) AS ticker, CAST(max(o_orderkey % 10) AS DOUBLE) / 50 AS weight FROM {orders} GROUP BY o_custkey, o_orderkey % 5"
_NEW = "SELECT c_custkey AS account_id, concat('K', CAST(k AS VARCHAR(9))) AS ticker, CASE WHEN k = 3 THEN 0.0 ELSE CAST((c_custkey + k) % 4 AS DOUBLE) / 4 END AS weight FROM {customer} CROSS JOIN (VALUES (1), (2), (3)) t(k) WHERE c_custkey % 3 = 0"


@query("snk07_replaced_plans", f"WITH a AS ({_PLAIN(_OLD)}), b AS ({_PLAIN(_NEW)}), s AS (SELECT account_id, sum(weight) AS total FROM b GROUP BY ALL) SELECT * FROM a WHERE account_id NOT IN (SELECT account_id FROM s WHERE total <= 1.0001) UNION ALL SELECT b.* FROM b JOIN s USING (account_id) WHERE total <= 1.0001 AND weight > 0")
def replaced_plans(spark, sf_dir):
    return ac.replace_plans(_sql(spark, sf_dir, _OLD), _sql(spark, sf_dir, _NEW))[0]


_NEWS = "SELECT concat('Brand#', CAST(page_id % 5 + 1 AS VARCHAR(9)), CAST(page_id % 4 + 1 AS VARCHAR(9))) AS ticker, CASE WHEN page_id % 6 > 0 THEN TIMESTAMP '2024-01-01' + page_id % 50 * INTERVAL '1' HOUR END AS ts, url AS headline FROM {pages}"


@query("agg53_holding_context", f"WITH {NAV}, ld AS (SELECT account_id, max(as_of_date) AS as_of_date FROM hold GROUP BY ALL), lv AS (SELECT account_id, ticker, CAST(v AS DOUBLE) AS v FROM hold JOIN ld USING (account_id, as_of_date) WHERE v IS NOT NULL), nw AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC NULLS LAST, headline) AS rn FROM ({_PLAIN(_NEWS)}) QUALIFY rn <= 5), nt AS (SELECT ticker, count(*) AS n_news, min_by(headline, rn) AS latest_headline FROM nw GROUP BY ALL) SELECT account_id, lv.ticker, round(v / sum(v) OVER (PARTITION BY account_id), 8) AS weight, coalesce(n_news, 0) AS n_news, latest_headline FROM lv LEFT JOIN nt ON nt.ticker = lv.ticker")
def holding_context(spark, sf_dir):
    return ac.holding_context(replayed(spark, sf_dir).holdings, _sql(spark, sf_dir, _NEWS)).withColumn("weight", F.round("weight", 8))


_STATES = "SELECT user_id AS endpoint, max_by(event_type, event_id) AS last_event, CAST(max(CASE WHEN event_type <> 'error' THEN ts END) AS TIMESTAMP) AS last_success FROM {events} GROUP BY user_id"


@query("flt14_fresh_metadata", f"SELECT endpoint, coalesce(last_event <> 'error' AND last_success >= TIMESTAMP '2024-01-30' - INTERVAL 24 HOUR, false) AS fresh FROM ({_PLAIN(_STATES)})")
def fresh_metadata(spark, sf_dir):
    s = _sql(spark, sf_dir, _STATES)
    return s.select("endpoint", ac.is_fresh(F.when(F.col("last_event") == "error", "failed").otherwise("success"), F.col("last_success"), F.lit("2024-01-30").cast("timestamp"), 24).alias("fresh"))


_FOLLOW = f"p AS ({_PLAIN(_POSITIONS)}), f AS (SELECT account_id, ticker FROM p WHERE ts = (SELECT max(ts) FROM p q WHERE q.account_id = p.account_id) UNION SELECT * FROM ({_PLAIN(_WATCH)}))"
_LISTED = "SELECT concat('K', CAST(p_partkey % 400 AS VARCHAR(9))) AS ticker, min(p_name) AS name FROM {part} GROUP BY p_partkey % 400"


@query("flt10_news_targets", f"WITH {_FOLLOW} SELECT ticker, name FROM ({_PLAIN(_LISTED)}) WHERE ticker IN (SELECT ticker FROM f)")
def news_targets(spark, sf_dir):
    return ac.news_targets(ag.followed(_sql(spark, sf_dir, _POSITIONS), _sql(spark, sf_dir, _WATCH)), _sql(spark, sf_dir, _LISTED))


@query("join17_tickers_of_symbols", f"WITH t AS (SELECT symbol AS s, max(ticker) AS ticker FROM ({_PLAIN(_TARGETS)}) WHERE symbol IS NOT NULL GROUP BY symbol) SELECT l_orderkey, l_linenumber, l_suppkey, ticker FROM lineitem JOIN t ON s = concat('S+ ', l_partkey, '~*')")
def tickers_of_symbols(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_suppkey", F.concat(F.lit("s+ "), F.col("l_partkey").cast("string"), F.lit("~*")).alias("code"))
    return ac.ticker_of_symbol(rows, _sql(spark, sf_dir, _TARGETS), "code", F.lower("symbol")).drop("code")


@query("join22_watch_and_held_flags", f"WITH p AS ({_PLAIN(_POSITIONS)}), w AS ({_PLAIN(_WATCH)}), x AS (SELECT DISTINCT o_custkey AS account_id, concat('K', o_orderkey % 310) AS ticker FROM orders) SELECT account_id, ticker, (account_id, ticker) IN (SELECT (account_id, ticker) FROM w) AS watched, (account_id, ticker) IN (SELECT (account_id, ticker) FROM p) AS held FROM x")
def watch_and_held(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("account_id"), F.concat(F.lit("K"), (F.col("o_orderkey") % 310).cast("string")).alias("ticker")).distinct()
    return ac.with_flags(rows, _sql(spark, sf_dir, _WATCH), _sql(spark, sf_dir, _POSITIONS))


_FETCHES = "SELECT CASE WHEN event_id % 3 = 0 THEN 'earnings' ELSE 'dividends' END AS kind, concat('K', CAST(event_id AS VARCHAR(20))) AS ticker, CASE WHEN event_id % 211 > 0 THEN CAST(date_trunc('hour', ts) AS TIMESTAMP) END AS fetched_at FROM {events}"


@query("stm11_due_by_kind", f"WITH f AS ({_PLAIN(_FETCHES)}), d AS (SELECT kind, ticker FROM f WHERE kind = 'dividends' AND (fetched_at IS NULL OR fetched_at <= TIMESTAMP '2024-01-30' - INTERVAL 168 HOUR) ORDER BY fetched_at NULLS FIRST, ticker LIMIT 4) SELECT kind, ticker FROM f WHERE kind = 'earnings' AND (fetched_at IS NULL OR fetched_at <= TIMESTAMP '2024-01-30' - INTERVAL 20 HOUR) UNION ALL SELECT * FROM d")
def due_by_kind(spark, sf_dir):
    return ac.due(_sql(spark, sf_dir, _FETCHES), F.lit("2024-01-30").cast("timestamp"))


@query("prj19_price_requests", f"WITH t AS ({_PLAIN(_TARGETS)}) SELECT ticker AS cache_key, symbol, 'EUR' AS currency, 'instrument' AS kind FROM t WHERE symbol IS NOT NULL UNION ALL SELECT concat('__benchmark_', r_name, '__'), concat(r_name, '.L'), 'USD', 'benchmark' FROM region UNION ALL SELECT concat('__sector_proxy_', s, '__'), s, min(c), 'sector' FROM (SELECT concat('X', n_regionkey) AS s, CASE WHEN n_nationkey % 2 = 0 THEN 'USD' ELSE 'GBP' END AS c FROM nation) GROUP BY s")
def price_requests(spark, sf_dir):
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    benchmarks = read("region").select(F.col("r_name").alias("key"), F.concat("r_name", F.lit(".L")).alias("symbol"), F.lit("USD").alias("currency"))
    proxies = read("nation").select(F.concat(F.lit(" x"), F.col("n_regionkey").cast("string")).alias("symbol"), F.when(F.col("n_nationkey") % 2 == 0, "USD").otherwise("GBP").alias("currency"))
    return ac.price_requests(_sql(spark, sf_dir, _TARGETS).withColumn("currency", F.lit("EUR")), benchmarks, proxies)


@query("prj23_plain_symbols", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN concat('NV', p_partkey) WHEN 1 THEN concat('VU', p_partkey) ELSE 'low' END AS symbol FROM part")
def plain_symbols(spark, sf_dir):
    k = F.col("p_partkey")
    ticker = F.when(k % 3 == 0, F.concat(F.lit("NV"), k.cast("string"), F.lit("_US_EQ"))).when(k % 3 == 1, F.concat(F.lit("VU"), k.cast("string"), F.lit("l_EQ"))).otherwise("low_EQ")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", ac.plain_symbol(ticker).alias("symbol"))


@query("snk10_reports", "SELECT s_suppkey, concat('{\"sSuppkey\":', s_suppkey, ',\"supplierName\":\"', s_name, '\",\"sNationkey\":', CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_nationkey AS VARCHAR) ELSE 'null' END, '}') AS report FROM supplier")
def reports(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_name", F.when(F.col("s_suppkey") % 2 == 0, F.col("s_nationkey")).alias("s_nationkey"))
    return ac.as_report(s, "s_suppkey", {"s_name": "supplierName"})


@query("agg47_table_stats", "SELECT 'documents' AS name, count(*) AS rows, CAST(coalesce(sum(strlen(text)), 0) AS BIGINT) AS bytes FROM documents UNION ALL SELECT 'pages', count(*), CAST(coalesce(sum(strlen(html)), 0) AS BIGINT) FROM pages UNION ALL SELECT 'orders', count(*), 0 FROM orders")
def table_stats(spark, sf_dir):
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return ac.table_stats({"documents": (read("documents"), "text"), "pages": (read("pages"), "html"), "orders": (read("orders"), None)})


_FLOWS = "SELECT o_custkey AS account_id, o_orderkey AS k, CASE WHEN o_orderkey % 3 > 0 THEN CAST(floor(o_totalprice) AS DECIMAL(28,10)) END AS deposit_eur, CASE WHEN o_orderkey % 5 > 0 THEN CAST(-o_orderkey AS DECIMAL(28,10)) END AS withdrawal_eur, CAST(o_orderkey % 2 * 2000 - 1000 AS DECIMAL(28,10)) AS external_flow_eur FROM {orders}"


@query("prj18_money_in_and_out", f"SELECT k, CAST(CASE WHEN deposit_eur IS NOT NULL AND withdrawal_eur IS NOT NULL THEN deposit_eur ELSE greatest(external_flow_eur, 0) END AS DOUBLE) AS money_in, CAST(CASE WHEN deposit_eur IS NOT NULL AND withdrawal_eur IS NOT NULL THEN withdrawal_eur ELSE least(external_flow_eur, 0) END AS DOUBLE) AS money_out FROM ({_PLAIN(_FLOWS)})")
def money_in_and_out(spark, sf_dir):
    rows = pd_.money_in_out(_sql(spark, sf_dir, _FLOWS))
    return rows.select("k", F.col("deposit_eur").cast(MONEY).cast("double").alias("money_in"), F.col("withdrawal_eur").cast(MONEY).cast("double").alias("money_out"))


_SEVERAL = "b AS (SELECT price_date AS d, substr(ticker, 7, 1) AS benchmark, max(close_price) AS c FROM v_prices GROUP BY ALL), br AS (SELECT d, benchmark, CAST(c AS DOUBLE) / CAST(lag(c) OVER (PARTITION BY benchmark ORDER BY d) AS DOUBLE) - 1 AS rb FROM b), j AS (SELECT t.account_id, br.benchmark, t.r AS rp, br.rb FROM twr t JOIN br ON br.d = t.as_of_date WHERE rb IS NOT NULL)"


@query("agg48_benchmark_report", f"WITH {NAV}, {_SEVERAL} SELECT account_id, benchmark, count(*) AS n, round(covar_samp(rp, rb) / var_samp(rb), 6) AS beta, round(corr(rp, rb), 6) AS correlation, round(stddev_samp(rp - rb) * sqrt(365), 6) AS tracking_error FROM j GROUP BY ALL")
def benchmark_report(spark, sf_dir):
    from pyspark.sql import Window

    from ledgerwell.plans.adapters import view

    px = view(spark, sf_dir, "v_prices").groupBy(F.col("price_date").alias("as_of_date"), F.substring("ticker", 7, 1).alias("benchmark")).agg(F.max("close_price").cast("double").alias("c"))
    rb = px.withColumn("rb", F.col("c") / F.lag("c").over(Window.partitionBy("benchmark").orderBy("as_of_date")) - 1).filter("rb is not null").drop("c")
    joined = rt.daily_twr(replayed(spark, sf_dir).nav).withColumnRenamed("twr", "rp").join(rb, "as_of_date")
    return rt.benchmark_stats(joined, ["account_id", "benchmark"]).select("account_id", "benchmark", "n", r("beta", 6), r("correlation", 6), r("tracking_error", 6))


@query("snk03_replaced_table", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 3 = 2")
def replaced_table(spark, sf_dir):
    folder, o = new_path(spark, "versions"), spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    for k in range(3):
        ac.replace_table(o.filter(F.col("o_orderkey") % 3 == k), folder)
    return ac.current_table(spark, folder)


_ALERTS = "SELECT event_id AS id, user_id AS account_id, event_type AS kind, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS created_at FROM {events}"


@query("src28_newest_of_account", f"SELECT id, kind, created_at::VARCHAR AS created_at FROM ({_PLAIN(_ALERTS)}) WHERE account_id = 7 AND kind = 'purchase' ORDER BY created_at DESC, id DESC LIMIT 10")
def newest_of_account(spark, sf_dir):
    rows = ac.listed(_sql(spark, sf_dir, _ALERTS), [F.desc("created_at"), F.desc("id")], 10, account_id=7, kind="purchase")
    return rows.select("id", "kind", F.col("created_at").cast("string").alias("created_at"))


_OVERRIDES = "SELECT concat('I', CAST(p_partkey AS VARCHAR(20))) AS isin, CASE p_partkey % 3 WHEN 0 THEN ' ' WHEN 1 THEN p_brand END AS sector FROM {part}"


@query("flt12_declared_sectors", "SELECT concat('I', p_partkey) AS isin, p_brand AS sector FROM part WHERE p_partkey % 3 = 1")
def declared_sectors(spark, sf_dir):
    return ac.declared(_sql(spark, sf_dir, _OVERRIDES), "sector")
