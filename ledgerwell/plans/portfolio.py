"""Queries over the replayed portfolio, each with SQL that computes the same in another way."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwell.functions.money import money_out
from ledgerwell.functions.storage import application_and_files, stored
from ledgerwell.operators import composition as co
from ledgerwell.operators import ledger as lg
from ledgerwell.operators import periods as pe
from ledgerwell.operators import replay as rp
from ledgerwell.operators import returns as rt
from ledgerwell.operators.asof import as_of, carry_forward, first_seen
from ledgerwell.plans.adapters import END, STALE, START, ledger, sql_views, summed_ledger, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def r(c: str, digits: int = 8):
    return F.round(F.col(c), digits).alias(c)


_replays: dict[tuple, rp.Stored] = {}


def computed(spark: SparkSession, sf_dir: str) -> rp.Replay:
    """The replay over the events of each day, which are stored: all parts of it read them."""
    led = summed_ledger(spark, sf_dir)
    events = stored(lg.daily_events(lg.ledger_events(led, lg.fx_daily(led.fx, STALE))), "events")
    return rp.from_events(events, led, START, END, STALE, STALE)


def replayed(spark: SparkSession, sf_dir: str) -> rp.Stored:
    """The replay as tables: each made once in an application and read by every report, until an input file is another one."""
    key = application_and_files(spark, sf_dir, "lineitem", "orders", "customer", "part", "events")
    if key not in _replays:
        _replays[key] = rp.Stored(computed(spark, sf_dir), START, END)
    return _replays[key]


EV = sql_views("v_fills", "v_dividends", "v_prices", "v_instruments", "v_fx", "v_cash") + f"""
, cash0 AS (SELECT c.*, CASE WHEN c.currency = 'EUR' THEN amount WHEN c.day - x.rate_date <= {STALE} THEN CAST(amount * x.eur_per_unit AS DECIMAL(28,10)) END AS eur
  FROM v_cash c ASOF LEFT JOIN v_fx x ON c.currency = x.currency AND c.day >= x.rate_date)
, cash1 AS (SELECT *, CASE WHEN eur IS NULL THEN 'excluded' WHEN transaction_type = 'FEE' THEN 'fee' WHEN transaction_type = 'INTEREST' THEN 'interest' WHEN action = 'Spending cashback' THEN 'cashback' WHEN action = 'Card debit' THEN 'card' ELSE 'external' END AS flow_class FROM cash0)
, ev AS (SELECT account_id, day, ticker, lower(side) AS kind, CASE side WHEN 'BUY' THEN quantity ELSE -quantity END AS q, CAST(net_value AS DECIMAL(28,10)) AS eur FROM v_fills
  UNION ALL SELECT account_id, day, ticker, 'dividend', NULL, amount FROM v_dividends
  UNION ALL SELECT account_id, day, NULL, flow_class, NULL, eur FROM cash1 WHERE flow_class <> 'excluded')
"""
HOLD = EV + f"""
, days AS (SELECT CAST(unnest(generate_series(DATE '{START}', DATE '{END}', INTERVAL 1 DAY)) AS DATE) AS d)
, pairs AS (SELECT DISTINCT account_id, ticker FROM v_fills)
, delta AS (SELECT account_id, ticker, day, sum(q) AS q FROM ev WHERE q IS NOT NULL GROUP BY ALL)
, qty AS (SELECT * FROM (SELECT p.account_id, p.ticker, d.d, sum(coalesce(t.q, 0)) OVER (PARTITION BY p.account_id, p.ticker ORDER BY d.d) AS quantity
  FROM pairs p CROSS JOIN days d LEFT JOIN delta t ON t.account_id = p.account_id AND t.ticker = p.ticker AND t.day = d.d) WHERE quantity <> 0)
, pr AS (SELECT q.*, i.currency, p.price_date, p.close_price FROM qty q JOIN v_instruments i USING (ticker) ASOF LEFT JOIN v_prices p ON q.ticker = p.ticker AND q.d >= p.price_date)
, fxd AS (SELECT pr.*, x.rate_date, x.eur_per_unit FROM pr ASOF LEFT JOIN v_fx x ON pr.currency = x.currency AND pr.d >= x.rate_date)
, hold0 AS (SELECT account_id, d AS as_of_date, ticker, quantity, currency, price_date, rate_date, CASE WHEN d - price_date <= {STALE} THEN close_price END AS close_price,
  CASE WHEN currency = 'EUR' THEN 1 WHEN d - rate_date <= {STALE} THEN eur_per_unit END AS fx FROM fxd)
, hold AS (SELECT *, CAST(quantity AS DECIMAL(22,2)) * CAST(close_price AS DECIMAL(12,4)) * CAST(fx AS DECIMAL(8,4)) AS v,
  CASE WHEN price_date IS NULL THEN 'MISSING_PRICE' WHEN close_price IS NULL THEN 'STALE_PRICE' WHEN fx IS NULL AND rate_date IS NULL THEN 'MISSING_FX' WHEN fx IS NULL THEN 'STALE_FX'
    WHEN as_of_date > price_date OR (currency <> 'EUR' AND as_of_date > rate_date) THEN 'FORWARD_FILL' ELSE 'VALUED' END AS status FROM hold0)
"""
NAV = HOLD + """
, accounts AS (SELECT DISTINCT account_id FROM ev)
, c AS (SELECT account_id, day, sum(CASE WHEN kind IN ('external', 'card') THEN eur ELSE 0 END) AS ext, sum(CASE WHEN kind = 'buy' THEN -eur WHEN kind IN ('external', 'card') THEN 0 ELSE eur END) AS internal,
    sum(CASE WHEN kind = 'dividend' THEN eur ELSE 0 END) AS dividend, sum(CASE WHEN kind = 'interest' THEN eur ELSE 0 END) AS interest, sum(CASE WHEN kind = 'fee' THEN eur ELSE 0 END) AS fee,
    sum(CASE WHEN kind IN ('external', 'card') AND eur >= 0 THEN eur ELSE 0 END) AS deposit, sum(CASE WHEN kind IN ('external', 'card') AND eur < 0 THEN eur ELSE 0 END) AS withdrawal,
    sum(CASE WHEN kind = 'card' THEN eur ELSE 0 END) AS card, sum(CASE WHEN kind = 'cashback' THEN eur ELSE 0 END) AS cashback FROM ev GROUP BY ALL)
, val AS (SELECT account_id, as_of_date, sum(v) AS v, count(*) FILTER (status LIKE '%_PRICE') AS mp, count(*) FILTER (status LIKE '%_FX') AS mf, bool_or(status = 'FORWARD_FILL') AS ff FROM hold GROUP BY ALL)
, nav AS (SELECT a.account_id, d.d AS as_of_date, sum(coalesce(c.ext, 0) + coalesce(c.internal, 0)) OVER (PARTITION BY a.account_id ORDER BY d.d) AS cash, coalesce(val.v, 0) AS sec, coalesce(mp, 0) AS mp, coalesce(mf, 0) AS mf, coalesce(ff, false) AS ff,
    coalesce(ext, 0) AS ext, coalesce(internal, 0) AS internal, coalesce(dividend, 0) AS dividend, coalesce(interest, 0) AS interest, coalesce(fee, 0) AS fee, coalesce(deposit, 0) AS deposit, coalesce(withdrawal, 0) AS withdrawal, coalesce(card, 0) AS card, coalesce(cashback, 0) AS cashback
  FROM accounts a CROSS JOIN days d LEFT JOIN c ON c.account_id = a.account_id AND c.day = d.d LEFT JOIN val ON val.account_id = a.account_id AND val.as_of_date = d.d)
, navs AS (SELECT *, CASE WHEN mp = 0 AND mf = 0 THEN cash + sec END AS nav FROM nav)
, twr0 AS (SELECT account_id, as_of_date, nav, ext, lag(nav) OVER (PARTITION BY account_id ORDER BY as_of_date) AS prev FROM navs)
, twr AS (SELECT account_id, as_of_date, CAST(nav - ext AS DOUBLE) / CAST(prev AS DOUBLE) - 1 AS r FROM twr0 WHERE nav IS NOT NULL AND prev IS NOT NULL AND prev <> 0)
, first_nav AS (SELECT account_id, min(as_of_date) AS d0 FROM navs WHERE nav > 0 GROUP BY ALL)
, idx AS (SELECT n.account_id, n.as_of_date, product(1 + coalesce(t.r, 0)) OVER (PARTITION BY n.account_id ORDER BY n.as_of_date) AS level FROM navs n JOIN first_nav f USING (account_id) LEFT JOIN twr t ON t.account_id = n.account_id AND t.as_of_date = n.as_of_date WHERE n.nav IS NOT NULL AND n.as_of_date >= f.d0)
"""
D4 = "CAST(round({0}, 4) AS DOUBLE) AS {1}".format


@query("agg01_ledger_rollup", f"WITH {EV} SELECT account_id, day, {', '.join(D4(f'sum(CASE WHEN kind = {k!r} THEN eur ELSE 0 END)', k + '_eur') for k in ('buy', 'sell', 'dividend', 'external', 'card', 'cashback', 'interest', 'fee'))} FROM ev GROUP BY ALL")
def ledger_rollup(spark, sf_dir):
    led = summed_ledger(spark, sf_dir)
    e = lg.ledger_events(led, lg.fx_daily(led.fx, STALE)).withColumn("kind", F.regexp_replace("kind", "^cash_", ""))
    return e.groupBy("account_id", "day").agg(*[money_out(F.sum(F.when(F.col("kind") == k, F.col("eur")).otherwise(0))).alias(f"{k}_eur") for k in ("buy", "sell", "dividend", "external", "card", "cashback", "interest", "fee")])


@query("prj04_cash_routing", f"WITH {EV} SELECT flow_class, currency, count(*) AS n, {D4('sum(eur)', 'eur')} FROM cash1 GROUP BY ALL")
def cash_routing(spark, sf_dir):
    led = ledger(spark, sf_dir)
    return lg.route_cash(led.cash, lg.fx_daily(led.fx, STALE)).groupBy("flow_class", "currency").agg(F.count("*").alias("n"), money_out(F.sum("eur")).alias("eur"))


@query("prj02_signed_quantity", f"WITH {sql_views('v_fills')} SELECT account_id, ticker, CAST(sum(CASE side WHEN 'BUY' THEN quantity ELSE -quantity END) AS DOUBLE) AS quantity FROM v_fills GROUP BY ALL")
def signed(spark, sf_dir):
    return view(spark, sf_dir, "v_fills").groupBy("account_id", "ticker").agg(F.sum(lg.signed_quantity(F.col("side"), F.col("quantity"))).cast("double").alias("quantity"))


@query("join01_asof_price", f"WITH {sql_views('v_prices')}, days AS (SELECT CAST(unnest(generate_series(DATE '{START}', DATE '{END}', INTERVAL 1 DAY)) AS DATE) AS d), keys AS (SELECT DISTINCT ticker FROM v_prices), s AS (SELECT * FROM keys CROSS JOIN days), j AS (SELECT s.ticker, s.d, p.price_date, p.close_price FROM s ASOF LEFT JOIN v_prices p ON s.ticker = p.ticker AND s.d >= p.price_date) SELECT ticker, d AS as_of_date, CASE WHEN price_date IS NULL THEN 'MISSING' WHEN price_date = d THEN 'EXACT' WHEN d - price_date > {STALE} THEN 'STALE' ELSE 'FORWARD_FILL' END AS status, CAST(CASE WHEN d - price_date <= {STALE} THEN close_price END AS DOUBLE) AS close_price FROM j")
def asof_price(spark, sf_dir):
    prices = view(spark, sf_dir, "v_prices")
    daily = carry_forward(prices.withColumnRenamed("price_date", "as_of_date"), ["ticker"], "as_of_date", STALE)
    first = first_seen(prices, ["ticker"], "price_date")
    spine = first.select("ticker", "first_seen", F.explode(F.sequence(F.lit(START).cast("date"), F.lit(END).cast("date"))).alias("as_of_date"))
    status = F.coalesce("provenance", F.when(F.col("as_of_date") < F.col("first_seen"), "MISSING").otherwise("STALE"))
    return spine.join(daily, ["ticker", "as_of_date"], "left").select("ticker", "as_of_date", status.alias("status"), F.col("close_price").cast("double").alias("close_price"))


@query("join03_latest_rate", f"WITH {sql_views('v_fx', 'v_cash')} SELECT c.reference, CAST(x.eur_per_unit AS DOUBLE) AS rate, x.rate_date AS found_on FROM v_cash c ASOF LEFT JOIN v_fx x ON c.currency = x.currency AND c.day >= x.rate_date")
def latest_rate(spark, sf_dir):
    return as_of(view(spark, sf_dir, "v_cash"), view(spark, sf_dir, "v_fx"), ["currency"], "day", "rate_date", ["eur_per_unit"]).select("reference", F.col("eur_per_unit").cast("double").alias("rate"), "found_on")


@query("join04_price_at_or_next", f"WITH {sql_views('v_prices', 'v_dividends')}, f AS (SELECT DISTINCT ticker, day FROM v_dividends), b AS (SELECT f.*, p.price_date AS pd, p.close_price AS pc FROM f ASOF LEFT JOIN v_prices p ON f.ticker = p.ticker AND f.day >= p.price_date), n AS (SELECT b.*, p.close_price AS nc, p.price_date AS nd FROM b ASOF LEFT JOIN v_prices p ON b.ticker = p.ticker AND b.day <= p.price_date) SELECT ticker, day, CAST(CASE WHEN day - pd <= 2 THEN pc ELSE nc END AS DOUBLE) AS close_price, CASE WHEN day - pd <= 2 THEN pd ELSE nd END AS found_on FROM n")
def at_or_next(spark, sf_dir):
    days = view(spark, sf_dir, "v_dividends").select("ticker", "day").distinct()
    return as_of(days, view(spark, sf_dir, "v_prices"), ["ticker"], "day", "price_date", ["close_price"], 2, or_next=True).select("ticker", "day", F.col("close_price").cast("double").alias("close_price"), "found_on")


@query("prj16_daily_holdings", f"WITH {HOLD} SELECT account_id, as_of_date, ticker, CAST(quantity AS DOUBLE) AS quantity, status AS valuation_status, {D4('v', 'market_value_eur')} FROM hold")
def daily_holdings(spark, sf_dir):
    return computed(spark, sf_dir).holdings.select("account_id", "as_of_date", "ticker", F.col("quantity").cast("double").alias("quantity"), "valuation_status", money_out(F.col("market_value_eur")).alias("market_value_eur"))


@query("agg02_daily_nav", f"WITH {NAV} SELECT account_id, as_of_date, {D4('cash', 'cash_balance_eur')}, {D4('nav', 'nav_eur')}, {D4('ext', 'external_flow_eur')}, {D4('internal', 'internal_cash_flow_eur')}, {D4('dividend', 'dividend_eur')}, {D4('interest', 'interest_eur')}, {D4('fee', 'fee_eur')}, {D4('deposit', 'deposit_eur')}, {D4('withdrawal', 'withdrawal_eur')}, {D4('card', 'card_spending_eur')}, {D4('cashback', 'cashback_eur')}, CASE WHEN mp + mf > 0 THEN 'PARTIAL' WHEN ff THEN 'FORWARD_FILL' ELSE 'VALUED' END AS valuation_status, CAST(mp AS BIGINT) AS missing_price_count, CAST(mf AS BIGINT) AS missing_fx_count FROM navs")
def daily_nav(spark, sf_dir):
    nav = computed(spark, sf_dir).nav
    money = [c for c in nav.columns if c.endswith("_eur") and c != "securities_value_eur"]
    return nav.select("account_id", "as_of_date", *[money_out(F.col(c)).alias(c) for c in money], "valuation_status", "missing_price_count", "missing_fx_count")


@query("win08_running_cash", f"WITH {NAV} SELECT account_id, as_of_date, {D4('sum(ext) OVER (PARTITION BY account_id ORDER BY as_of_date)', 'net_deposits_eur')} FROM nav")
def net_deposits(spark, sf_dir):
    return pe.net_deposits_to_date(replayed(spark, sf_dir).nav).select("account_id", "as_of_date", money_out(F.col("net_deposits_eur")).alias("net_deposits_eur"))


@query("win01_daily_twr", f"WITH {NAV} SELECT account_id, as_of_date, round(r, 8) AS twr FROM twr")
def daily_twr(spark, sf_dir):
    return rt.daily_twr(replayed(spark, sf_dir).nav).select("account_id", "as_of_date", r("twr"))


@query("win01_daily_twr_split", f"WITH {NAV} SELECT account_id, as_of_date, round(CAST(nav - ext AS DOUBLE) / CAST(prev + CAST(ext AS DECIMAL(28,10)) * CAST(0.5 AS DECIMAL(2,1)) AS DOUBLE) - 1, 8) AS twr FROM twr0 WHERE nav IS NOT NULL AND prev IS NOT NULL AND prev + CAST(ext AS DECIMAL(28,10)) * CAST(0.5 AS DECIMAL(2,1)) <> 0")
def twr_split(spark, sf_dir):
    return rt.daily_twr(replayed(spark, sf_dir).nav, "split").select("account_id", "as_of_date", r("twr"))


@query("win02_twr_index", f"WITH {NAV} SELECT account_id, as_of_date, round(level, 6) AS level FROM idx")
def twr_index(spark, sf_dir):
    return rt.twr_index(replayed(spark, sf_dir).nav).select("account_id", "as_of_date", r("level", 6))


@query("win04_drawdown_series", f"WITH {NAV} SELECT account_id, as_of_date, round(level / max(level) OVER (PARTITION BY account_id ORDER BY as_of_date) - 1, 6) AS drawdown FROM idx")
def drawdowns(spark, sf_dir):
    return rt.drawdown_series(rt.twr_index(replayed(spark, sf_dir).nav)).select("account_id", "as_of_date", r("drawdown", 6))


@query("win03_worst_drawdown", f"WITH {NAV}, dd AS (SELECT *, max(level) OVER (PARTITION BY account_id ORDER BY as_of_date) AS peak FROM idx), w AS (SELECT account_id, min(level / peak - 1) AS drawdown, arg_min(as_of_date, (level / peak - 1, as_of_date)) AS trough_date FROM dd GROUP BY ALL), p AS (SELECT w.*, (SELECT max(x.as_of_date) FROM dd x WHERE x.account_id = w.account_id AND x.as_of_date <= w.trough_date AND x.level >= x.peak) AS peak_date FROM w), q AS (SELECT p.*, (SELECT min(x.as_of_date) FROM dd x WHERE x.account_id = p.account_id AND x.as_of_date > p.trough_date AND x.level >= (SELECT y.level FROM dd y WHERE y.account_id = p.account_id AND y.as_of_date = p.peak_date)) AS recovery_date FROM p) SELECT account_id, round(drawdown, 6) AS drawdown, peak_date, trough_date, recovery_date FROM q")
def worst_drawdown(spark, sf_dir):
    return rt.worst_drawdown(rt.twr_index(replayed(spark, sf_dir).nav)).select("account_id", r("drawdown", 6), "peak_date", "trough_date", "recovery_date")


@query("agg11_risk_metrics", f"WITH {NAV} SELECT account_id, count(*) AS n, round(product(1 + r) - 1, 6) AS cumulative, round(CASE WHEN product(1 + r) > 0 THEN power(product(1 + r), 365.0 / count(*)) - 1 END, 6) AS annualised, round(stddev_samp(r) * sqrt(365), 6) AS volatility, round(stddev_samp(r) FILTER (r < 0) * sqrt(365), 6) AS downside_volatility, round(avg(r) * 365 / (stddev_samp(r) * sqrt(365)), 6) AS sharpe, round(avg(r) * 365 / (stddev_samp(r) FILTER (r < 0) * sqrt(365)), 6) AS sortino FROM twr GROUP BY ALL")
def risk(spark, sf_dir):
    m = rt.risk_metrics(rt.daily_twr(replayed(spark, sf_dir).nav))
    return m.select("account_id", "n", *[r(c, 6) for c in ("cumulative", "annualised", "volatility", "downside_volatility", "sharpe", "sortino")])


@query("agg12_var_cvar", f"WITH {NAV}, h AS (SELECT account_id, 1 AS horizon, r FROM twr UNION ALL SELECT account_id, 10, p FROM (SELECT account_id, product(1 + r) OVER w - 1 AS p, count(*) OVER w AS n FROM twr WINDOW w AS (PARTITION BY account_id ORDER BY as_of_date ROWS 9 PRECEDING)) WHERE n = 10), q AS (SELECT account_id, horizon, count(*) AS n, unnest([95, 99]) AS confidence, unnest([quantile_cont(r, 0.05), quantile_cont(r, 0.01)]) AS v FROM h GROUP BY account_id, horizon HAVING count(*) >= 20) SELECT q.account_id, q.horizon, q.confidence, q.n, round(q.v, 6) AS var, round(avg(h.r), 6) AS cvar FROM q JOIN h ON h.account_id = q.account_id AND h.horizon = q.horizon AND h.r <= q.v + 1e-13 GROUP BY ALL")
def var_cvar(spark, sf_dir):
    return rt.var_cvar(rt.daily_twr(replayed(spark, sf_dir).nav)).select("account_id", "horizon", "confidence", "n", r("var", 6), r("cvar", 6))


BENCH = f"{NAV}, px AS (SELECT price_date AS d, max(close_price) AS c FROM v_prices GROUP BY ALL), br AS (SELECT d, CAST(c AS DOUBLE) / CAST(lag(c) OVER (ORDER BY d) AS DOUBLE) - 1 AS rb FROM px), j AS (SELECT t.account_id, t.as_of_date, t.r AS rp, br.rb FROM twr t JOIN br ON br.d = t.as_of_date WHERE rb IS NOT NULL)"


def _joined(spark, sf_dir) -> DataFrame:
    from pyspark.sql import Window

    px = replayed(spark, sf_dir).prices.groupBy(F.col("price_date").alias("as_of_date")).agg(F.max("close_price").cast("double").alias("c"))
    rb = px.withColumn("rb", F.col("c") / F.lag("c").over(Window.orderBy("as_of_date")) - 1).filter("rb is not null").drop("c")  # one row a day
    return rt.daily_twr(replayed(spark, sf_dir).nav).withColumnRenamed("twr", "rp").join(rb, "as_of_date")


@query("agg13_benchmark_stats", f"WITH {BENCH} SELECT account_id, count(*) AS n, round(covar_samp(rp, rb) / var_samp(rb), 6) AS beta, round((avg(rp) - covar_samp(rp, rb) / var_samp(rb) * avg(rb)) * 365, 6) AS alpha, round(power(corr(rp, rb), 2), 6) AS r2, round(corr(rp, rb), 6) AS correlation, round(stddev_samp(rp - rb) * sqrt(365), 6) AS tracking_error, round(avg(rp - rb) * 365 / (stddev_samp(rp - rb) * sqrt(365)), 6) AS information_ratio FROM j GROUP BY ALL")
def benchmark_stats(spark, sf_dir):
    s = rt.benchmark_stats(_joined(spark, sf_dir), ["account_id"])
    return s.select("account_id", "n", *[r(c, 6) for c in ("beta", "alpha", "r2", "correlation", "tracking_error", "information_ratio")])


@query("join05_aligned_returns", f"WITH {BENCH} SELECT account_id, as_of_date, round(rp, 8) AS rp, round(rb, 8) AS rb FROM j")
def aligned(spark, sf_dir):
    return _joined(spark, sf_dir).select("account_id", "as_of_date", r("rp"), r("rb"))


@query("win06_rolling_beta", f"WITH {BENCH} SELECT account_id, as_of_date, round(c / v, 4) AS beta FROM (SELECT account_id, as_of_date, covar_samp(rp, rb) OVER w AS c, var_samp(rb) OVER w AS v, count(*) OVER w AS n FROM j WINDOW w AS (PARTITION BY account_id ORDER BY as_of_date ROWS 29 PRECEDING)) WHERE n = 30 AND v > 0")
def rolling_beta(spark, sf_dir):
    return rt.rolling_beta(_joined(spark, sf_dir), 30).select("account_id", "as_of_date", r("beta", 4))


@query("win05_rolling_volatility", f"WITH {NAV}, a AS (SELECT account_id, as_of_date, stddev_samp(r) OVER w AS s, count(*) OVER w AS n, stddev_samp(r) OVER z AS l, count(*) OVER z AS m FROM twr WINDOW w AS (PARTITION BY account_id ORDER BY as_of_date ROWS 29 PRECEDING), z AS (PARTITION BY account_id ORDER BY as_of_date ROWS 89 PRECEDING)) SELECT account_id, as_of_date, round(s * sqrt(365), 5) AS short_volatility, round(CASE WHEN m = 90 THEN l * sqrt(365) END, 5) AS long_volatility FROM a WHERE n = 30")
def rolling_volatility(spark, sf_dir):
    return rt.rolling_both(rt.daily_twr(replayed(spark, sf_dir).nav)).select("account_id", "as_of_date", r("short_volatility", 5), r("long_volatility", 5))


@query("win07_horizon_returns", f"WITH {NAV} SELECT account_id, as_of_date, round(p, 6) AS ret FROM (SELECT account_id, as_of_date, product(1 + r) OVER w - 1 AS p, count(*) OVER w AS n FROM twr WINDOW w AS (PARTITION BY account_id ORDER BY as_of_date ROWS 9 PRECEDING)) WHERE n = 10")
def horizon(spark, sf_dir):
    return rt.horizon_returns(rt.daily_twr(replayed(spark, sf_dir).nav), 10).select("account_id", "as_of_date", r("ret", 6))


WEIGHTS = f"{HOLD}, lastd AS (SELECT account_id, max(as_of_date) AS d FROM hold GROUP BY ALL), w AS (SELECT h.account_id, h.ticker, CAST(v AS DOUBLE) / CAST(sum(v) OVER (PARTITION BY h.account_id) AS DOUBLE) AS weight FROM hold h JOIN lastd ON lastd.account_id = h.account_id AND lastd.d = h.as_of_date WHERE v IS NOT NULL)"


@query("agg14_latest_weights", f"WITH {WEIGHTS} SELECT account_id, ticker, round(weight, 8) AS weight FROM w")
def latest_weights(spark, sf_dir):
    return co.latest_weights(replayed(spark, sf_dir).holdings).select("account_id", "ticker", r("weight"))


@query("agg14_average_weights", f"WITH {HOLD}, s AS (SELECT account_id, as_of_date, ticker, CAST(v AS DOUBLE) / CAST(sum(v) OVER (PARTITION BY account_id, as_of_date) AS DOUBLE) AS share FROM hold WHERE v IS NOT NULL), n AS (SELECT account_id, count(DISTINCT as_of_date) AS n FROM s GROUP BY ALL) SELECT account_id, ticker, round(sum(share) / any_value(n.n), 6) AS weight FROM s JOIN n USING (account_id) GROUP BY ALL")
def average_weights(spark, sf_dir):
    return co.average_weights(replayed(spark, sf_dir).holdings).select("account_id", "ticker", r("weight", 6))


@query("agg15_concentration", f"WITH {WEIGHTS} SELECT account_id, round(sum(weight * weight), 6) AS hhi, round(1 / sum(weight * weight), 6) AS effective_holdings, round(sum(weight) FILTER (rn <= 5), 6) AS top_weight FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY weight DESC, ticker) AS rn FROM w) GROUP BY ALL")
def concentration(spark, sf_dir):
    return co.concentration(co.latest_weights(replayed(spark, sf_dir).holdings)).select("account_id", r("hhi", 6), r("effective_holdings", 6), r("top_weight", 6))


UNIT = "u AS (SELECT account_id, ticker, as_of_date, CAST(v AS DOUBLE) / CAST(quantity AS DOUBLE) AS p FROM hold WHERE v IS NOT NULL), ur AS (SELECT account_id, ticker, as_of_date, p / lag(p) OVER (PARTITION BY account_id, ticker ORDER BY as_of_date) - 1 AS ret FROM u)"


@query("agg16_contributions", f"WITH {WEIGHTS}, {UNIT}, l AS (SELECT account_id, ticker, arg_max(ret, as_of_date) AS ret FROM ur WHERE ret IS NOT NULL GROUP BY ALL) SELECT w.account_id, w.ticker, round(weight * ret, 8) AS contribution, CASE WHEN ret IS NULL THEN 'insufficient_data' ELSE 'ok' END AS status FROM w LEFT JOIN l USING (account_id, ticker)")
def contributions(spark, sf_dir):
    h = replayed(spark, sf_dir).holdings
    return co.contributions(co.latest_weights(h), co.price_returns(h)).select("account_id", "ticker", r("contribution"), "status")


@query("win10_unit_price_returns", f"WITH {HOLD}, {UNIT} SELECT account_id, ticker, as_of_date, round(ret, 7) AS ret FROM ur WHERE ret IS NOT NULL")
def unit_returns(spark, sf_dir):
    return co.price_returns(replayed(spark, sf_dir).holdings).select("account_id", "ticker", "as_of_date", r("ret", 7))


@query("win11_window_returns", f"WITH {HOLD}, {UNIT} SELECT account_id, ticker, round(arg_max(p, as_of_date) / arg_min(p, as_of_date) - 1, 6) AS ret FROM u GROUP BY ALL HAVING count(*) >= 2")
def window_returns(spark, sf_dir):
    return co.window_returns(replayed(spark, sf_dir).holdings).select("account_id", "ticker", r("ret", 6))


def _sector_groups(spark, sf_dir) -> DataFrame:
    h = replayed(spark, sf_dir).holdings
    sectors = view(spark, sf_dir, "v_instruments").select("ticker", "sector")
    j = co.average_weights(h).join(co.window_returns(h), ["account_id", "ticker"]).join(sectors, "ticker")
    return j.groupBy("account_id", "sector").agg(F.sum("weight").alias("wp"), (F.sum(F.col("weight") * F.col("ret")) / F.sum("weight")).alias("rp"))


@query("agg17_brinson", f"WITH {HOLD}, {UNIT}, s AS (SELECT account_id, as_of_date, ticker, CAST(v AS DOUBLE) / CAST(sum(v) OVER (PARTITION BY account_id, as_of_date) AS DOUBLE) AS share FROM hold WHERE v IS NOT NULL), n AS (SELECT account_id, count(DISTINCT as_of_date) AS n FROM s GROUP BY ALL), aw AS (SELECT account_id, ticker, sum(share) / any_value(n.n) AS w FROM s JOIN n USING (account_id) GROUP BY ALL), wr AS (SELECT account_id, ticker, arg_max(p, as_of_date) / arg_min(p, as_of_date) - 1 AS ret FROM u GROUP BY ALL HAVING count(*) >= 2), g AS (SELECT aw.account_id, sector, sum(w) AS wp, sum(w * ret) / sum(w) AS rp FROM aw JOIN wr USING (account_id, ticker) JOIN v_instruments USING (ticker) GROUP BY ALL), b AS (SELECT * FROM (VALUES ('Energy', 0.5, 0.1), ('Health Care', 0.3, 0.05), ('Utilities', 0.2, 0.02)) t(sector, wb, rb)), ab AS (SELECT DISTINCT g.account_id, b.* FROM g CROSS JOIN b), j AS (SELECT coalesce(g.account_id, ab.account_id) AS account_id, coalesce(g.sector, ab.sector) AS sector, coalesce(wp, 0) AS wp, coalesce(wb, 0) AS wb, coalesce(rb, 0) AS rb, coalesce(rp, rb, 0) AS rp FROM g FULL JOIN ab ON g.account_id = ab.account_id AND g.sector = ab.sector) SELECT account_id, sector, round((wp - wb) * (rb - 0.069), 6) AS allocation, round(wb * (rp - rb), 6) AS selection, round((wp - wb) * (rp - rb), 6) AS interaction FROM j")
def brinson(spark, sf_dir):
    benchmark = spark.createDataFrame([("Energy", 0.5, 0.1), ("Health Care", 0.3, 0.05), ("Utilities", 0.2, 0.02)], "sector string, wb double, rb double")
    return co.brinson(_sector_groups(spark, sf_dir), benchmark).select("account_id", "sector", r("allocation", 6), r("selection", 6), r("interaction", 6))


@query("agg45_return_histogram", f"WITH {NAV}, e AS (SELECT account_id, min(r) AS lo, max(r) AS hi FROM twr GROUP BY ALL) SELECT t.account_id, CAST(least(floor((r - lo) / ((hi - lo) / 18)), 17) AS INTEGER) AS bin, count(*) AS n FROM twr t JOIN e USING (account_id) GROUP BY ALL")
def return_histogram(spark, sf_dir):
    return co.histogram(rt.daily_twr(replayed(spark, sf_dir).nav), "account_id", "twr")


@query("agg44_allocation_donut", f"WITH {WEIGHTS} SELECT account_id, CASE WHEN rn <= 5 THEN ticker ELSE 'Other' END AS slice, round(sum(weight), 6) AS weight, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY weight DESC, ticker) AS rn FROM w) GROUP BY ALL")
def donut(spark, sf_dir):
    return co.donut(co.latest_weights(replayed(spark, sf_dir).holdings)).select("account_id", "slice", r("weight", 6), "n")


BOUNDS = """
, ends AS (SELECT account_id, max(as_of_date) AS e FROM navs WHERE nav IS NOT NULL GROUP BY ALL)
, nom AS (SELECT account_id, e, unnest(['1W', '1M', '3M', 'YTD', '1Y', 'ALL']) AS period, unnest([e - 7, CAST(e - INTERVAL 1 MONTH AS DATE), CAST(e - INTERVAL 3 MONTH AS DATE), date_trunc('year', e)::DATE - 1, CAST(e - INTERVAL 12 MONTH AS DATE), NULL]) AS s FROM ends)
, wk AS (SELECT account_id, as_of_date, row_number() OVER (PARTITION BY account_id ORDER BY as_of_date DESC) AS rn FROM navs WHERE nav IS NOT NULL AND dayofweek(as_of_date) BETWEEN 1 AND 5)
, bounds AS (SELECT account_id, period, (SELECT max(x.as_of_date) FROM navs x WHERE x.account_id = nom.account_id AND x.nav IS NOT NULL AND x.as_of_date <= nom.s) AS start_date, e AS end_date FROM nom
  UNION ALL SELECT account_id, '1D', min(as_of_date), max(as_of_date) FROM wk WHERE rn <= 2 GROUP BY ALL HAVING count(*) = 2)
"""
MONTHS = """
, mo AS (SELECT account_id, date_trunc('month', as_of_date)::DATE AS m, max(as_of_date) FILTER (nav IS NOT NULL) AS end_date FROM navs GROUP BY ALL)
, bounds AS (SELECT account_id, strftime(m, '%Y-%m') AS period, max(end_date) OVER (PARTITION BY account_id ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS start_date, end_date FROM mo WHERE m <= (SELECT max(as_of_date) FROM navs z WHERE z.account_id = mo.account_id AND z.nav IS NOT NULL))
"""
SUMMARY = """
, su AS (SELECT b.account_id, b.period, b.start_date, b.end_date, sum(deposit) AS dep, sum(withdrawal) AS wd, sum(dividend) AS dv, sum(interest) AS it, sum(fee) AS fe, sum(cashback) AS cb, product(1 + t.r) - 1 AS twr, count(*) FILTER (n.nav IS NULL) AS unvalued_days
  FROM bounds b JOIN navs n ON n.account_id = b.account_id AND n.as_of_date <= b.end_date AND (b.start_date IS NULL OR n.as_of_date > b.start_date) LEFT JOIN twr t ON t.account_id = n.account_id AND t.as_of_date = n.as_of_date GROUP BY ALL)
, sv AS (SELECT su.*, CASE WHEN start_date IS NULL THEN 0 ELSE a.nav END AS v0, z.nav AS v1 FROM su LEFT JOIN navs a ON a.account_id = su.account_id AND a.as_of_date = su.start_date LEFT JOIN navs z ON z.account_id = su.account_id AND z.as_of_date = su.end_date)
SELECT account_id, period, start_date, end_date, """ + ", ".join([D4("v1 - v0", "value_change_eur"), D4("dep + wd", "net_deposits_eur"), D4("v1 - v0 - dep - wd", "result_eur"), D4("v1 - v0 - dep - wd - dv - it - cb - fe", "market_eur"), "round(twr, 6) AS twr", "unvalued_days"]) + " FROM sv"


def _summary(nav: DataFrame, bounds: DataFrame, disjoint: bool = False) -> DataFrame:
    s = pe.summarise(nav, rt.daily_twr(nav), bounds, disjoint)
    return s.select("account_id", "period", "start_date", "end_date", *[money_out(F.col(c)).alias(c) for c in ("value_change_eur", "net_deposits_eur", "result_eur", "market_eur")], r("twr", 6), "unvalued_days")


@query("agg04_period_summaries", f"WITH {NAV} {BOUNDS} {SUMMARY}")
def period_summaries(spark, sf_dir):
    nav = replayed(spark, sf_dir).nav
    return _summary(nav, pe.period_bounds(nav))


@query("agg05_monthly_summaries", f"WITH {NAV} {MONTHS} {SUMMARY}")
def monthly_summaries(spark, sf_dir):
    nav = replayed(spark, sf_dir).nav
    return _summary(nav, pe.month_bounds(nav), disjoint=True)


@query("agg06_holding_movements", f"WITH {NAV} {BOUNDS}, fl AS (SELECT b.account_id, b.period, ev.ticker, sum(CASE kind WHEN 'buy' THEN eur ELSE 0 END) AS bo, sum(CASE kind WHEN 'sell' THEN eur ELSE 0 END) AS so, sum(CASE kind WHEN 'dividend' THEN eur ELSE 0 END) AS dv FROM bounds b JOIN ev ON ev.account_id = b.account_id AND ev.ticker IS NOT NULL AND ev.day <= b.end_date AND (b.start_date IS NULL OR ev.day > b.start_date) AND ev.day >= DATE '{START}' GROUP BY ALL), e AS (SELECT b.account_id, b.period, h.ticker, h.v FROM bounds b JOIN hold h ON h.account_id = b.account_id AND h.as_of_date = b.end_date), s AS (SELECT b.account_id, b.period, h.ticker, h.v FROM bounds b JOIN hold h ON h.account_id = b.account_id AND h.as_of_date = b.start_date), k AS (SELECT account_id, period, ticker FROM fl UNION SELECT account_id, period, ticker FROM e UNION SELECT account_id, period, ticker FROM s), m AS (SELECT k.*, CASE WHEN s.ticker IS NULL THEN 0 ELSE s.v END AS v0, CASE WHEN e.ticker IS NULL THEN 0 ELSE e.v END AS v1, coalesce(bo, 0) AS bo, coalesce(so, 0) AS so, coalesce(fl.dv, 0) AS dv FROM k LEFT JOIN s USING (account_id, period, ticker) LEFT JOIN e USING (account_id, period, ticker) LEFT JOIN fl USING (account_id, period, ticker)) SELECT account_id, period, ticker, {D4('v1 - v0 - bo + so + dv', 'result_eur')}, round(CASE WHEN v0 + bo > 0 THEN CAST(v1 - v0 - bo + so + dv AS DOUBLE) / CAST(v0 + bo AS DOUBLE) END, 6) AS return_pct FROM m")
def holding_movements(spark, sf_dir):
    rep = replayed(spark, sf_dir)
    m = pe.holding_movements(rep.holdings, rep.flows, pe.period_bounds(rep.nav))
    return m.select("account_id", "period", "ticker", money_out(F.col("result_eur")).alias("result_eur"), r("return_pct", 6))
