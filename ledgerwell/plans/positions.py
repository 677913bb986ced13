"""Queries over positions, exports, goals, income and listings, with SQL for the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwell.functions import money as mo
from ledgerwell.operators import household as hh
from ledgerwell.operators import ledger as lg
from ledgerwell.operators import positions as ps
from ledgerwell.plans import household as hp
from ledgerwell.plans import portfolio as pf
from ledgerwell.plans.adapters import END, START, sql_views, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
TODAY = "2001-12-15"


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def r(c: str, digits: int = 6):
    return F.round(F.col(c), digits).alias(c)


_ADM = "fill_type = 'TRADE' AND side IN ('BUY', 'SELL') AND quantity IS NOT NULL"


@query("join07_reconciliation", f"WITH {sql_views('v_orders', 'v_positions')}, l AS (SELECT account_id, ticker, sum(quantity) AS q FROM v_positions GROUP BY ALL), f AS (SELECT account_id, ticker, sum(CASE WHEN {_ADM} THEN CASE side WHEN 'BUY' THEN abs(quantity) ELSE -abs(quantity) END END) AS q, bool_or(NOT coalesce({_ADM}, false)) AS odd FROM v_orders GROUP BY ALL) SELECT coalesce(l.account_id, f.account_id) AS account_id, coalesce(l.ticker, f.ticker) AS ticker, CAST(coalesce(l.q, 0) AS DOUBLE) AS live_quantity, CAST(coalesce(f.q, 0) AS DOUBLE) AS replayed_quantity, CAST(coalesce(l.q, 0) - coalesce(f.q, 0) AS DOUBLE) AS difference, CASE WHEN odd THEN 'UNSUPPORTED_ACTION' WHEN abs(coalesce(l.q, 0) - coalesce(f.q, 0)) <= 0.000001 THEN 'MATCH' ELSE 'MISMATCH' END AS status FROM l FULL JOIN f ON l.account_id = f.account_id AND l.ticker = f.ticker")
def reconciliation(spark, sf_dir):
    out = ps.reconcile(view(spark, sf_dir, "v_positions"), view(spark, sf_dir, "v_orders"))
    return out.select("account_id", "ticker", *[F.col(c).cast("double").alias(c) for c in ("live_quantity", "replayed_quantity", "difference")], "status")


@query("flt02_unsupported_tickers", f"WITH {sql_views('v_orders')} SELECT DISTINCT ticker FROM v_orders WHERE NOT coalesce({_ADM}, false)")
def unsupported_tickers(spark, sf_dir):
    return lg.unsupported_tickers(view(spark, sf_dir, "v_orders").withColumn("fill_timestamp", F.lit("2000-01-01").cast("timestamp")))


@query("flt01_fill_admission", f"WITH {sql_views('v_orders')} SELECT fill_type, side, CAST(coalesce({_ADM}, false) AS BOOLEAN) AS admitted, count(*) AS n FROM v_orders GROUP BY ALL")
def fill_admission(spark, sf_dir):
    f = view(spark, sf_dir, "v_orders")
    return f.groupBy("fill_type", "side", F.coalesce(lg.admitted(f), F.lit(False)).alias("admitted")).agg(F.count("*").alias("n"))


_LEGS = "lg0 AS (SELECT *, CASE transaction_type WHEN 'WITHDRAW' THEN 'out' WHEN 'DEPOSIT' THEN 'in' END AS way FROM v_moves), at_ AS (SELECT account_id, ts, list(DISTINCT upper(currency)) FILTER (way = 'out') AS o, list(DISTINCT upper(currency)) FILTER (way = 'in') AS i FROM lg0 GROUP BY ALL), legs AS (SELECT lg0.account_id, reference FROM lg0 JOIN at_ USING (account_id, ts) WHERE way IS NOT NULL AND len(o) > 0 AND len(i) > 0 AND NOT list_has_any(o, i))"


@query("join11_conversion_legs", f"WITH {sql_views('v_moves')}, {_LEGS} SELECT account_id, reference FROM legs")
def conversion_legs(spark, sf_dir):
    return lg.conversion_legs(view(spark, sf_dir, "v_moves"))


@query("join12_unlabelled_withdrawals", f"WITH {sql_views('v_moves', 'v_export')}, {_LEGS} SELECT m.account_id, m.reference, CAST(amount AS DOUBLE) AS amount FROM v_moves m WHERE transaction_type = 'WITHDRAW' AND amount < 0 AND reference NOT IN (SELECT row_id FROM v_export) AND NOT EXISTS (SELECT 1 FROM legs l WHERE l.account_id = m.account_id AND l.reference = m.reference)")
def unlabelled(spark, sf_dir):
    out = ps.unlabelled_withdrawals(view(spark, sf_dir, "v_moves"), view(spark, sf_dir, "v_export"))
    return out.select("account_id", "reference", F.col("amount").cast("double").alias("amount"))


@query("join10_export_labels", f"WITH {sql_views('v_moves', 'v_export')} SELECT reference, action FROM v_moves LEFT JOIN v_export ON reference = row_id")
def export_labels(spark, sf_dir):
    return ps.label_moves(view(spark, sf_dir, "v_moves"), view(spark, sf_dir, "v_export")).select("reference", "action")


@query("prj06_minor_units", "SELECT c_custkey, CASE upper(u) WHEN 'GBX' THEN 'GBP' WHEN 'ZAC' THEN 'ZAR' WHEN 'ILA' THEN 'ILS' ELSE upper(u) END AS currency, round(c_acctbal / CASE WHEN upper(u) IN ('GBX', 'ZAC', 'ILA') THEN 100 ELSE 1 END, 6) AS amount FROM (SELECT c_custkey, c_acctbal, CASE c_custkey % 5 WHEN 0 THEN 'GBX' WHEN 1 THEN 'zac' WHEN 2 THEN 'ILA' WHEN 3 THEN 'usd' ELSE 'EUR' END AS u FROM customer)")
def minor_units(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").withColumn("u", F.expr("CASE c_custkey % 5 WHEN 0 THEN 'GBX' WHEN 1 THEN 'zac' WHEN 2 THEN 'ILA' WHEN 3 THEN 'usd' ELSE 'EUR' END"))
    return c.select("c_custkey", mo.major_currency(F.col("u")).alias("currency"), F.round(F.col("c_acctbal") / mo.unit_divisor(F.col("u")), 6).alias("amount"))


@query("flt08_alert_met", "SELECT c_custkey, coalesce(CASE k WHEN 'above' THEN p >= t WHEN 'below' THEN p <= t WHEN 'gain_pct' THEN CASE WHEN c_acctbal > 0 THEN (p / c_acctbal - 1) * 100 >= t END WHEN 'loss_pct' THEN CASE WHEN c_acctbal > 0 THEN (p / c_acctbal - 1) * 100 <= -t END END, false) AS met FROM (SELECT *, CASE c_custkey % 5 WHEN 0 THEN 'above' WHEN 1 THEN 'below' WHEN 2 THEN 'gain_pct' WHEN 3 THEN 'loss_pct' ELSE 'other' END AS k, CAST(c_custkey * 13 % 9000 AS DOUBLE) AS p, CAST(c_custkey % 60 AS DOUBLE) AS t FROM customer)")
def alerts(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    kind = F.expr("CASE c_custkey % 5 WHEN 0 THEN 'above' WHEN 1 THEN 'below' WHEN 2 THEN 'gain_pct' WHEN 3 THEN 'loss_pct' ELSE 'other' END")
    met = ps.alert_met(kind, (F.col("c_custkey") % 60).cast("double"), (F.col("c_custkey") * 13 % 9000).cast("double"), F.col("c_acctbal"))
    return c.select("c_custkey", met.alias("met"))


_CAT = "SELECT concat(p_brand, '_', CAST(p_partkey AS VARCHAR(9))) AS ticker, p_name AS name, p_brand AS short_name, concat('US', lpad(CAST(p_partkey AS VARCHAR(9)), 10, '0')) AS isin FROM {part}"


@query("flt05_catalogue_search", f"WITH c AS ({_CAT.replace('{part}', 'part')}) SELECT ticker, name, CAST(CASE WHEN upper(short_name) = 'BRAND#13' THEN 0 WHEN starts_with(upper(ticker), 'BRAND#13_') THEN 1 WHEN starts_with(upper(name), 'BRAND#13') THEN 2 ELSE 3 END AS INTEGER) AS rank FROM c WHERE contains(upper(name), 'BRAND#13') OR contains(upper(short_name), 'BRAND#13') OR contains(upper(ticker), 'BRAND#13') ORDER BY rank, length(name), ticker LIMIT 20")
def catalogue_search(spark, sf_dir):
    catalogue = spark.sql(_CAT, part=spark.read.parquet(f"{sf_dir}/part.parquet"))
    return ps.search(catalogue, " brand#13 ").select("ticker", "name", "rank")


@query("srt05_pagination", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25 OFFSET 50")
def pagination(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_acctbal")
    return ps.page_of(c, [F.desc("c_acctbal"), F.col("c_custkey")], 3, 25)


@query("srt06_round_to_cents", f"WITH p AS (SELECT account_id, ticker, buy AS x FROM ({hp.ORACLE_SQL['sim04_plan_allocation']})), q AS (SELECT *, x * 100 AS c, floor(x * 100) AS f, floor(sum(x) OVER (PARTITION BY account_id) * 100 + 0.5) - sum(floor(x * 100)) OVER (PARTITION BY account_id) AS lft FROM p) SELECT account_id, CAST(sum(f) + max(lft) AS BIGINT) AS cents, count(*) AS n FROM q GROUP BY ALL")
def round_to_cents(spark, sf_dir):
    p = hp.QUERIES["sim04_plan_allocation"](spark, sf_dir)
    return hh.round_to_cents(p, ["account_id"], "buy", "ticker").groupBy("account_id").agg(F.sum("cents").alias("cents"), F.count("*").alias("n"))


@query("join13_cached_and_fetched", f"WITH {sql_views('v_prices')}, c AS (SELECT ticker, price_date, CAST(close_price AS DOUBLE) AS v FROM v_prices WHERE day(price_date) <= 20), f AS (SELECT ticker, price_date, CAST(close_price AS DOUBLE) + 1 AS v FROM v_prices WHERE day(price_date) >= 15) SELECT * FROM f UNION ALL SELECT c.* FROM c WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.ticker = c.ticker AND f.price_date = c.price_date)")
def cached_and_fetched(spark, sf_dir):
    p = view(spark, sf_dir, "v_prices").select("ticker", "price_date", F.col("close_price").cast("double").alias("v"))
    return ps.with_priority(p.filter(F.dayofmonth("price_date") <= 20), p.filter(F.dayofmonth("price_date") >= 15).withColumn("v", F.col("v") + 1), ["ticker", "price_date"])


@query("flt03_price_coverage", f"WITH {sql_views('v_prices')}, w AS (SELECT DISTINCT p_brand AS ticker FROM part UNION ALL SELECT 'NONE'), h AS (SELECT ticker, min(price_date) AS lo, max(price_date) AS hi FROM v_prices WHERE ticker NOT LIKE '%2' OR price_date > DATE '1999-01-01' GROUP BY ALL) SELECT w.ticker, CASE WHEN lo IS NULL THEN 'missing' WHEN lo > DATE '{START}' + 10 THEN 'starts_late' ELSE 'ends_early' END AS reason FROM w LEFT JOIN h USING (ticker) WHERE lo IS NULL OR lo > DATE '{START}' + 10 OR hi < DATE '{END}' - 10")
def price_coverage(spark, sf_dir):
    prices = view(spark, sf_dir, "v_prices").filter("ticker not like '%2' or price_date > date'1999-01-01'")
    wanted = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_brand").alias("ticker")).distinct().unionByName(spark.createDataFrame([("NONE",)], "ticker string"))
    return ps.needs_fetch(wanted, prices, START, END, 10)


@query("set03_missing_tickers", f"WITH {sql_views('v_positions')} SELECT DISTINCT p_brand AS ticker FROM part WHERE p_brand NOT IN (SELECT ticker FROM v_positions)")
def missing_tickers(spark, sf_dir):
    held = view(spark, sf_dir, "v_positions").select("ticker").distinct()
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_brand").alias("ticker")).distinct().join(held, "ticker", "left_anti")


@query("flt15_latest_export", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_export(spark, sf_dir):
    return ps.latest_of(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


_CARDROWS = "SELECT event_id, user_id, CAST(date_trunc('month', CAST(ts AS DATE)) AS DATE) AS month, CASE event_type WHEN 'purchase' THEN 'card' WHEN 'error' THEN 'card' WHEN 'click' THEN 'cashback' END AS label, CASE WHEN event_id % 3 = 0 THEN 'USD' ELSE 'EUR' END AS currency, CAST(value AS DECIMAL(14,2)) * CASE WHEN event_type = 'purchase' THEN -1 ELSE 1 END AS amount FROM {events}"


@query("agg24_card_summary", f"WITH e AS ({_CARDROWS.replace('{events}', 'events')}), g AS (SELECT month, sum(CASE WHEN label = 'card' AND amount < 0 THEN -amount ELSE 0 END) AS s, sum(CASE WHEN label = 'card' AND amount > 0 THEN amount ELSE 0 END) AS f, sum(CASE WHEN label = 'cashback' THEN amount ELSE 0 END) AS b, count(*) FILTER (label = 'card') AS n FROM e GROUP BY ALL), c AS (SELECT month, currency FROM (SELECT month, currency, count(*) AS k FROM e GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY month ORDER BY k DESC, currency) = 1) SELECT month, CAST(s AS DOUBLE) AS spent, CAST(f AS DOUBLE) AS refunded, CAST(b AS DOUBLE) AS cashback, round(CASE WHEN s - f > 0 THEN CAST(b AS DOUBLE) / CAST(s - f AS DOUBLE) END, 6) AS cashback_rate, n, currency FROM g JOIN c USING (month)")
def card_summary(spark, sf_dir):
    rows = spark.sql(_CARDROWS, events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    return hh.card_summary(rows, ["month"]).select("month", *[F.col(c).cast("double").alias(c) for c in ("spent", "refunded", "cashback")], r("cashback_rate"), "n", "currency")


@query("agg25_monthly_buckets", f"{hp.CARD}, w AS (SELECT *, CAST(date_trunc('month', day) AS DATE) AS mk FROM v_card), e AS (SELECT merchant, unnest(generate_series(min(mk), max(mk), INTERVAL 1 MONTH))::DATE AS bucket FROM w GROUP BY merchant) SELECT e.merchant, e.bucket, CAST(coalesce(sum(spent), 0) AS DOUBLE) AS spent, count(event_id) AS n FROM e LEFT JOIN w c ON c.merchant = e.merchant AND c.mk = e.bucket GROUP BY ALL")
def monthly_buckets(spark, sf_dir):
    return hh.buckets(view(spark, sf_dir, "v_card"), "merchant", "month").withColumn("spent", F.col("spent").cast("double"))


@query("agg27_merchant_profile", f"{hp.CARD}, h AS (SELECT merchant, hour(ts) AS h FROM v_card GROUP BY merchant, hour(ts) QUALIFY row_number() OVER (PARTITION BY merchant ORDER BY sum(spent) DESC, hour(ts)) = 1), l AS (SELECT merchant, event_id, spent FROM v_card QUALIFY row_number() OVER (PARTITION BY merchant ORDER BY spent DESC, ts, event_id) = 1), g AS (SELECT merchant, CAST(sum(spent) AS DOUBLE) AS s, count(*) AS n, min(ts) AS a, max(ts) AS b FROM v_card GROUP BY merchant) SELECT g.merchant, floor(s * 100 + 0.5) / 100 AS spent, n, floor(s / n * 100 + 0.5) / 100 AS average, CAST(l.spent AS DOUBLE) AS largest, l.event_id AS largest_id, strftime(a, '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(b, '%Y-%m-%d %H:%M:%S') AS last_ts, CAST(h.h AS INTEGER) AS busiest_hour FROM g JOIN h USING (merchant) JOIN l USING (merchant)")
def merchant_profile(spark, sf_dir):
    p = hh.merchant_profile(view(spark, sf_dir, "v_card"))
    return p.withColumn("first_ts", F.date_format("first_ts", "yyyy-MM-dd HH:mm:ss")).withColumn("last_ts", F.date_format("last_ts", "yyyy-MM-dd HH:mm:ss"))


@query("agg29_budget_notices", f"WITH b AS ({hp.ORACLE_SQL['agg29_budget_lines']}), k AS (SELECT category, CASE WHEN spent > monthly_limit THEN 'over' WHEN spent / 20 * 31 > monthly_limit THEN 'pace' END AS kind FROM b WHERE monthly_limit > 0) SELECT category, kind, concat('budget:2024-01:', category, ':', kind) AS dedupe_key FROM k WHERE kind IS NOT NULL")
def budget_notices(spark, sf_dir):
    return hh.budget_notices(hp.QUERIES["agg29_budget_lines"](spark, sf_dir), hp.TODAY)


@query("agg30_cash_flow_months", f"WITH {pf.NAV} SELECT account_id, strftime(as_of_date, '%Y-%m') AS month, " + ", ".join(f"floor(CAST(sum({x}) AS DOUBLE) * 100 + 0.5) / 100 AS {n}" for x, n in (("deposit", "deposited"), ("-card", "spent_by_card"), ("greatest(-withdrawal + card, 0)", "to_bank"), ("deposit + withdrawal", "kept"))) + " FROM navs GROUP BY ALL")
def cash_flow_months(spark, sf_dir):
    return hh.cash_flow_months(pf.replayed(spark, sf_dir).nav)


_DIV = f"WITH {sql_views('v_dividends')}"


@query("agg32_net_share", f"{_DIV}, p AS (SELECT account_id, ticker, day, amount, amount * (1 + (CAST(amount AS INTEGER) % 5) / 10.0) AS gross FROM v_dividends), l AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY account_id, ticker ORDER BY day DESC, amount DESC, gross DESC) <= 8) SELECT account_id, ticker, round(least(greatest(median(CASE WHEN gross > 0 THEN CAST(amount AS DOUBLE) / CAST(gross AS DOUBLE) END), 0.5), 1.0), 6) AS net_share FROM l GROUP BY ALL HAVING count(*) FILTER (gross > 0) > 0")
def net_share(spark, sf_dir):
    d = view(spark, sf_dir, "v_dividends")
    d = d.withColumn("gross", F.col("amount") * (1 + F.round(F.col("amount"), 0).cast("int") % 5 / F.lit(10.0)))
    return hh.net_share(d, ["account_id", "ticker"], "day", "amount", "gross").select("account_id", "ticker", r("net_share"))


_RHYTHM = hp.ORACLE_SQL["agg31_dividend_rhythm"]
_PROJ = f"WITH rh AS ({_RHYTHM.replace(chr(39) + TODAY + chr(39), '')}), v AS (SELECT c_mktsegment AS account_id, p_brand AS ticker, CAST(l_shipdate AS DATE) AS day, CAST(l_tax * 1000 AS DECIMAL(14,2)) AS amount FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'A' AND l_linenumber = 2), rq AS (SELECT account_id, ticker, 4 + CAST(substr(ticker, length(ticker), 1) AS INTEGER) % 2 * 8 AS per_year FROM v GROUP BY ALL), la AS (SELECT account_id, ticker, max(day) AS last_day, CAST(max(amount) FILTER (day = mx) AS DOUBLE) AS amount FROM (SELECT *, max(day) OVER (PARTITION BY account_id, ticker) AS mx FROM v) GROUP BY ALL), st AS (SELECT la.*, 12 // per_year AS step FROM la JOIN rq USING (account_id, ticker)), pj AS (SELECT account_id, ticker, CAST(last_day + to_months(CAST(k * step AS INTEGER)) AS DATE) AS day, amount FROM st, range(1, 200) t(k))"


def _projected(spark, sf_dir) -> DataFrame:
    d = view(spark, sf_dir, "v_dividends")
    keys = ["account_id", "ticker"]
    rhythm = d.select(*keys).distinct().withColumn("per_year", 4 + F.substring("ticker", -1, 1).cast("int") % 2 * 8)
    last = d.groupBy(*keys).agg(F.max(F.struct("day", "amount")).alias("l")).select(*keys, F.col("l.day").alias("last_day"), F.col("l.amount").cast("double").alias("amount"))
    return hh.project_payments(rhythm, last, keys, TODAY)


@query("agg33_dividend_projection", f"{_PROJ} SELECT account_id, ticker, day, amount FROM pj WHERE day >= DATE '{TODAY}' AND day < CAST(DATE '{TODAY}' + INTERVAL 12 MONTH AS DATE)")
def dividend_projection(spark, sf_dir):
    return _projected(spark, sf_dir)


@query("agg34_income_months", f"{_PROJ}, g AS (SELECT unnest(generate_series(DATE '2000-12-01', DATE '2002-11-01', INTERVAL 1 MONTH))::DATE AS m), rc AS (SELECT date_trunc('month', day)::DATE AS m, CAST(sum(amount) AS DOUBLE) AS x FROM v WHERE day < DATE '{TODAY}' GROUP BY ALL), pr AS (SELECT date_trunc('month', day)::DATE AS m, sum(amount) AS x FROM pj WHERE day >= DATE '{TODAY}' AND day < CAST(DATE '{TODAY}' + INTERVAL 12 MONTH AS DATE) GROUP BY ALL) SELECT strftime(g.m, '%Y-%m') AS month, round(coalesce(rc.x, 0), 2) AS received, round(coalesce(pr.x, 0), 2) AS projected FROM g LEFT JOIN rc ON rc.m = g.m LEFT JOIN pr ON pr.m = g.m")
def income_months(spark, sf_dir):
    first = F.add_months(F.trunc(F.lit(TODAY).cast("date"), "month"), -12)
    grid = spark.range(24).select(F.add_months(first, F.col("id").cast("int")).alias("m"))
    by = lambda df, name: df.groupBy(F.trunc("day", "month").alias("m")).agg(F.sum("amount").cast("double").alias(name))
    received = by(view(spark, sf_dir, "v_dividends").filter(F.col("day") < F.lit(TODAY).cast("date")), "received")
    rows = grid.join(received, "m", "left").join(by(_projected(spark, sf_dir), "projected"), "m", "left")
    return rows.select(F.date_format("m", "yyyy-MM").alias("month"), *[F.round(F.coalesce(c, F.lit(0.0)), 2).alias(c) for c in ("received", "projected")])


@query("agg35_pay_matrix", f"{_PROJ} SELECT ticker, " + ", ".join(f"round(coalesce(sum(amount) FILTER (month(day) = {m}), 0), 2) AS m{m}" for m in range(1, 13)) + f", round(sum(amount), 2) AS total FROM pj WHERE day >= DATE '{TODAY}' AND day < CAST(DATE '{TODAY}' + INTERVAL 12 MONTH AS DATE) GROUP BY ALL")
def pay_matrix(spark, sf_dir):
    p = _projected(spark, sf_dir)
    return p.groupBy("ticker").agg(*[F.round(F.coalesce(F.sum(F.when(F.month("day") == m, F.col("amount"))), F.lit(0.0)), 2).alias(f"m{m}") for m in range(1, 13)], F.round(F.sum("amount"), 2).alias("total"))


@query("agg43_holdings_totals", f"WITH {pf.HOLD}, l AS (SELECT * FROM hold QUALIFY as_of_date = max(as_of_date) OVER (PARTITION BY account_id)) SELECT account_id, currency, count(*) AS n, {pf.D4('sum(v)', 'value_eur')}, {pf.D4('max(v)', 'largest_eur')} FROM l GROUP BY ALL")
def holdings_totals(spark, sf_dir):
    h = pf.replayed(spark, sf_dir).holdings
    last = h.groupBy("account_id").agg(F.max("as_of_date").alias("as_of_date"))
    rows = h.join(last, ["account_id", "as_of_date"], "left_semi")
    return rows.groupBy("account_id", F.col("price_currency").alias("currency")).agg(F.count("*").alias("n"), mo.money_out(F.sum("market_value_eur")).alias("value_eur"), mo.money_out(F.max("market_value_eur")).alias("largest_eur"))


_GOAL = "SELECT c_custkey, CASE c_custkey % 2 WHEN 0 THEN 'value' ELSE 'income' END AS kind, c_acctbal AS v, CASE c_custkey % 2 WHEN 0 THEN 9000.0 ELSE 20.0 END AS target, c_custkey % 60 - 5 AS m, power(1 + (c_custkey % 8 + 1) / 100.0, 1 / 12.0) - 1 AS rt, c_acctbal * 0.04 AS income FROM customer WHERE c_acctbal > 0"


@query("sim03_goals", f"WITH g AS ({_GOAL}), e AS (SELECT *, CASE WHEN m <= 0 THEN v ELSE v * power(1 + rt, m) + 10.0 * ((power(1 + rt, m) - 1) / rt) END AS ev FROM g), s AS (SELECT *, CASE kind WHEN 'income' THEN income / 12 ELSE v END AS cur, CASE kind WHEN 'income' THEN ev * (income / v) / 12 ELSE ev END AS proj, CASE kind WHEN 'income' THEN target * 12 / (income / v) ELSE target END AS need FROM e), t AS (SELECT *, CASE WHEN cur >= target THEN 'reached' WHEN m <= 0 THEN 'missed' WHEN proj >= target THEN 'on-track' ELSE 'behind' END AS status FROM s) SELECT c_custkey, status, round(proj, 3) AS projected, round(CASE WHEN status = 'behind' THEN CASE WHEN need - v * power(1 + rt, m) <= 0 THEN 0 ELSE (need - v * power(1 + rt, m)) * rt / (power(1 + rt, m) - 1) END END, 3) AS required_monthly FROM t")
def goals(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").filter("c_acctbal > 0")
    k = F.col("c_custkey")
    kind = F.when(k % 2 == 0, "value").otherwise("income")
    goal = hh.goal_status(kind, F.col("c_acctbal"), F.when(k % 2 == 0, 9000.0).otherwise(20.0), k % 60 - 5, F.lit(10.0), (k % 8 + 1) / 100.0, F.col("c_acctbal") * 0.04)
    return c.select("c_custkey", goal.alias("g")).select("c_custkey", "g.status", F.round("g.projected", 3).alias("projected"), F.round("g.required_monthly", 3).alias("required_monthly"))
