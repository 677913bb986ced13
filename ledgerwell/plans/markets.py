"""Queries over returns, prices and factors, each with SQL that computes the same in another way."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerwell.functions.money import money_out
from ledgerwell.operators import composition as co
from ledgerwell.operators import ledger as lg
from ledgerwell.operators import markets as mk
from ledgerwell.operators import periods as pe
from ledgerwell.operators import returns as rt
from ledgerwell.plans import portfolio as pf
from ledgerwell.plans.adapters import STALE, ledger, sql_views, summed_ledger, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
D4 = pf.D4
PX = "px AS (SELECT price_date AS d, CAST(max(close_price) AS DOUBLE) AS c FROM v_prices GROUP BY ALL)"


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def r(c: str, digits: int = 6):
    return F.round(F.col(c), digits).alias(c)


def _nav(spark, sf_dir) -> DataFrame:
    return pf.replayed(spark, sf_dir).nav


_SQL_FLOWS = f"""{pf.NAV}, lastn AS (SELECT account_id, max(as_of_date) AS d, arg_max(nav, as_of_date) AS v FROM navs WHERE nav IS NOT NULL GROUP BY ALL)
, fl AS (SELECT account_id, day, sum(a) AS a FROM (SELECT n.account_id, as_of_date AS day, -CAST(ext AS DOUBLE) AS a FROM navs n JOIN lastn USING (account_id) WHERE ext <> 0 AND as_of_date <= d UNION ALL SELECT account_id, d, CAST(v AS DOUBLE) FROM lastn) GROUP BY ALL)
, cf AS (SELECT account_id, list(CAST(day - d0 AS DOUBLE) / 365.0 ORDER BY day) AS y, list(a ORDER BY day) AS a, min(a) AS lo_, max(a) AS hi_, count(*) AS n FROM (SELECT *, min(day) OVER (PARTITION BY account_id) AS d0 FROM fl) GROUP BY account_id)"""
_WORTH = "list_sum(list_transform(list_zip({p}y, {p}a), lambda x: x[2] / power(1 + {r}, x[1])))".format


@query("agg22_xirr", f"""WITH RECURSIVE {_SQL_FLOWS}
, hi AS (SELECT cf.*, (SELECT min(power(2.0, k)) FROM range(13) t(k) WHERE {_WORTH(p='cf.', r='(-0.999999)')} * {_WORTH(p='cf.', r='power(2.0, k)')} <= 0) AS hi0 FROM cf)
, it AS (SELECT account_id, y, a, {_WORTH(p='', r='(-0.999999)')} AS f0, CAST(-0.999999 AS DOUBLE) AS lo, hi0 AS hi, 0 AS k FROM hi WHERE hi0 IS NOT NULL
  UNION ALL SELECT account_id, y, a, f0, CASE WHEN f0 * {_WORTH(p='', r='((lo + hi) / 2)')} <= 0 THEN lo ELSE (lo + hi) / 2 END, CASE WHEN f0 * {_WORTH(p='', r='((lo + hi) / 2)')} <= 0 THEN (lo + hi) / 2 ELSE hi END, k + 1 FROM it WHERE k < 60)
SELECT hi.account_id, CASE WHEN n < 2 THEN 'insufficient_data' WHEN lo_ >= 0 OR hi_ <= 0 THEN 'no_sign_change' WHEN hi0 IS NULL THEN 'no_bracket' ELSE 'ok' END AS status, CASE WHEN n >= 2 AND lo_ < 0 AND hi_ > 0 THEN round((it.lo + it.hi) / 2, 6) END AS xirr, n FROM hi LEFT JOIN it ON it.account_id = hi.account_id AND it.k = 60""")
def xirr(spark, sf_dir):
    return mk.xirr(mk.account_flows(_nav(spark, sf_dir)), ["account_id"]).select("account_id", "status", r("xirr"), "n")


@query("agg11_calmar", f"WITH {pf.NAV}, m AS (SELECT account_id, count(*) AS n, CASE WHEN count(*) >= 2 AND product(1 + r) > 0 THEN power(product(1 + r), 365.0 / count(*)) - 1 END AS annualised, stddev_samp(r) AS s FROM twr GROUP BY ALL), dd AS (SELECT account_id, min(level / pk - 1) AS worst FROM (SELECT *, max(level) OVER (PARTITION BY account_id ORDER BY as_of_date) AS pk FROM idx) GROUP BY ALL) SELECT account_id, round(CASE WHEN worst <> 0 THEN annualised / abs(worst) END, 5) AS calmar, CASE WHEN annualised IS NULL OR worst IS NULL OR worst = 0 THEN 'insufficient_data' ELSE 'ok' END AS calmar_status, CASE WHEN n < 2 OR s IS NULL OR s = 0 THEN 'insufficient_data' ELSE 'ok' END AS sharpe_status FROM m LEFT JOIN dd USING (account_id)")
def calmar(spark, sf_dir):
    nav = _nav(spark, sf_dir)
    m = rt.risk_metrics(rt.daily_twr(nav)).join(rt.worst_drawdown(rt.twr_index(nav)).select("account_id", "drawdown"), "account_id", "left")
    value = F.try_divide(F.col("annualised"), F.abs("drawdown"))
    return m.select("account_id", F.round(value, 5).alias("calmar"), F.when(value.isNull(), "insufficient_data").otherwise("ok").alias("calmar_status"), F.when(F.col("sharpe").isNull(), "insufficient_data").otherwise("ok").alias("sharpe_status"))


def _passive(spark, sf_dir) -> DataFrame:
    nav = _nav(spark, sf_dir)
    flows = nav.filter("external_flow_eur <> 0").select("account_id", "as_of_date", F.col("external_flow_eur").alias("eur"))
    prices = pf.replayed(spark, sf_dir).prices.groupBy("price_date").agg(F.max("close_price").cast("double").alias("close"))
    return co.counterfactual(flows, prices, nav.select("account_id", "as_of_date"), STALE)


_PASSIVE = f"""{pf.NAV}, {PX}, dd AS (SELECT DISTINCT as_of_date AS d FROM navs), b AS (SELECT dd.d, px.d AS pd, px.c AS pc FROM dd ASOF LEFT JOIN px ON dd.d >= px.d), bn AS (SELECT b.*, px.c AS nc FROM b ASOF LEFT JOIN px ON b.d <= px.d)
, at_ AS (SELECT d, CASE WHEN d - pd <= {STALE} THEN pc ELSE nc END AS c FROM bn), u AS (SELECT n.account_id, n.as_of_date, at_.c, CASE WHEN ext <> 0 THEN CAST(ext AS DOUBLE) / at_.c END AS u, CASE WHEN ext <> 0 AND at_.c IS NULL THEN 1 ELSE 0 END AS lost, n.nav FROM navs n JOIN at_ ON at_.d = n.as_of_date)
, h AS (SELECT account_id, as_of_date, nav, c, sum(u) OVER w AS units, sum(lost) OVER w AS excluded FROM u WINDOW w AS (PARTITION BY account_id ORDER BY as_of_date))"""


@query("agg23_passive_counterfactual", f"WITH {_PASSIVE} SELECT account_id, as_of_date, round(units, 4) AS units, round(units * c, 2) AS value, CAST(excluded AS BIGINT) AS excluded FROM h WHERE units IS NOT NULL AND c IS NOT NULL")
def passive(spark, sf_dir):
    return _passive(spark, sf_dir).select("account_id", "as_of_date", r("units", 4), r("value", 2), F.col("excluded").cast("long").alias("excluded"))


@query("join20_nav_and_passive", f"WITH {_PASSIVE} SELECT account_id, as_of_date, {D4('nav', 'nav_eur')}, round(units * c, 2) AS passive_eur FROM h")
def nav_and_passive(spark, sf_dir):
    return _nav(spark, sf_dir).join(_passive(spark, sf_dir), ["account_id", "as_of_date"], "left").select("account_id", "as_of_date", money_out(F.col("nav_eur")).alias("nav_eur"), F.round("value", 2).alias("passive_eur"))


_UR = f"{pf.HOLD}, {pf.UNIT}, hp AS (SELECT account_id, ticker FROM ur WHERE ret IS NOT NULL GROUP BY account_id, ticker QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY ticker) <= 6), rr AS (SELECT ur.* FROM ur JOIN hp USING (account_id, ticker) WHERE ret IS NOT NULL), cd AS (SELECT account_id, as_of_date FROM rr GROUP BY account_id, as_of_date HAVING count(DISTINCT ticker) = (SELECT count(*) FROM hp WHERE hp.account_id = rr.account_id)), cr AS (SELECT rr.* FROM rr JOIN cd USING (account_id, as_of_date))"


def _first_holdings(spark, sf_dir) -> DataFrame:
    """Unit price returns of the first six tickers of each account: the report's correlations are of a few chosen holdings."""
    ret = co.price_returns(pf.replayed(spark, sf_dir).holdings)
    few = ret.select("account_id", "ticker").distinct().withColumn("rn", F.row_number().over(Window.partitionBy("account_id").orderBy("ticker"))).filter("rn <= 6")
    return ret.join(few, ["account_id", "ticker"], "left_semi")


@query("agg20_correlations", f"WITH {_UR} SELECT x.account_id, x.ticker AS a, y.ticker AS b, count(*) AS n, round(corr(x.ret, y.ret), 5) AS correlation FROM cr x JOIN cr y ON x.account_id = y.account_id AND x.as_of_date = y.as_of_date AND x.ticker < y.ticker GROUP BY ALL")
def correlations(spark, sf_dir):
    return mk.correlations(_first_holdings(spark, sf_dir)).select("account_id", "a", "b", "n", r("correlation", 5))


@query("agg20_clusters")
def clusters(spark, sf_dir):
    return mk.clusters(mk.correlations(_first_holdings(spark, sf_dir)), 1.35)


@query("set02_common_days", f"WITH {_UR} SELECT account_id, as_of_date FROM cd")
def common_days(spark, sf_dir):
    ret = _first_holdings(spark, sf_dir)
    held = ret.groupBy("account_id").agg(F.count_distinct("ticker").alias("held"))
    return ret.groupBy("account_id", "as_of_date").agg(F.count_distinct("ticker").alias("there")).join(held, "account_id").filter("there = held").select("account_id", "as_of_date")


_FACTORS = "fct AS (SELECT CAST(o_orderdate AS DATE) AS d, CAST((sum(o_orderkey) % 997) AS DOUBLE) / 50000 - 0.01 AS mkt_rf, CAST((sum(o_custkey) % 991) AS DOUBLE) / 50000 - 0.01 AS smb, CAST((max(o_orderkey) % 983) AS DOUBLE) / 50000 - 0.01 AS hml, CAST((min(o_orderkey) % 977) AS DOUBLE) / 50000 - 0.01 AS rmw, CAST((max(o_custkey) % 971) AS DOUBLE) / 50000 - 0.01 AS cma, CASE WHEN count(*) > 1 THEN CAST((min(o_custkey) % 967) AS DOUBLE) / 50000 - 0.01 END AS mom, 0.0001 AS rf FROM orders GROUP BY ALL)"


def _factors(spark, sf_dir) -> DataFrame:
    scaled = lambda c, m: c % m / 50000.0 - 0.01
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_orderdate").cast("date").alias("as_of_date"))
    return o.agg(
        scaled(F.sum("o_orderkey"), 997).alias("mkt_rf"), scaled(F.sum("o_custkey"), 991).alias("smb"), scaled(F.max("o_orderkey"), 983).alias("hml"), scaled(F.min("o_orderkey"), 977).alias("rmw"),
        scaled(F.max("o_custkey"), 971).alias("cma"), F.when(F.count("*") > 1, scaled(F.min("o_custkey"), 967)).alias("mom"), F.lit(0.0001).alias("rf"),
    )


@query("join06_returns_factors", f"WITH {pf.NAV}, {_FACTORS} SELECT t.account_id, t.as_of_date, round(t.r - rf, 8) AS y, round(mkt_rf, 8) AS mkt_rf, round(mom, 8) AS mom FROM twr t JOIN fct ON fct.d = t.as_of_date WHERE mom IS NOT NULL")
def returns_factors(spark, sf_dir):
    return mk.factor_rows(rt.daily_twr(_nav(spark, sf_dir)), _factors(spark, sf_dir)).select("account_id", "as_of_date", r("y", 8), r("mkt_rf", 8), r("mom", 8))


_TERMS = ("1.0", *mk.FACTORS)
#: The normal equations of each account, solved by elimination, a column a step.
_LEAST_SQUARES = f"""x AS (SELECT t.account_id, t.r - rf AS y, {', '.join(mk.FACTORS)} FROM twr t JOIN fct ON fct.d = t.as_of_date WHERE mom IS NOT NULL),
eq AS (SELECT account_id, count(*) AS n, sum(y * y) AS yy, sum(y) AS sy, [{', '.join('[' + ', '.join(f'sum({a} * {b})' for b in (*_TERMS, 'y')) + ']' for a in _TERMS)}] AS m FROM x GROUP BY ALL),
g AS (SELECT account_id, 1 AS k, m FROM eq UNION ALL SELECT account_id, k + 1, list_transform(m, lambda w, i: CASE WHEN i = k THEN list_transform(w, lambda z: z / m[k][k]) ELSE list_transform(w, lambda z, j: z - w[k] * m[k][j] / m[k][k]) END) FROM g WHERE k <= {len(_TERMS)}),
b AS (SELECT account_id, list_transform(m, lambda w: w[{len(_TERMS) + 1}]) AS b FROM g WHERE k = {len(_TERMS) + 1}),
lsq AS (SELECT account_id, n, b, 1 - (yy - list_sum(list_transform(b, lambda z, i: z * m[i][{len(_TERMS) + 1}]))) / (yy - sy * sy / n) AS r2 FROM eq JOIN b USING (account_id))"""


@query("agg21_factor_model", f"WITH RECURSIVE {pf.NAV}, {_FACTORS}, {_LEAST_SQUARES} SELECT account_id, n, CASE WHEN n >= {mk.LEAST_FACTOR_ROWS} THEN 'ok' ELSE 'insufficient_data' END AS status, " + ", ".join(f"CASE WHEN n >= {mk.LEAST_FACTOR_ROWS} THEN round({x}, 5) END AS {c}" for c, x in [("alpha", "b[1]"), *[(f, f"b[{i + 2}]") for i, f in enumerate(mk.FACTORS)], ("r2", "r2")]) + " FROM lsq")
def factor_model(spark, sf_dir):
    rows = mk.factor_rows(rt.daily_twr(_nav(spark, sf_dir)), _factors(spark, sf_dir))
    return mk.factor_model(rows, ["account_id"]).select("account_id", "n", "status", *[r(c, 5) for c in ("alpha", *mk.FACTORS, "r2")])


@query("agg21_one_factor", f"WITH {pf.NAV}, {_FACTORS} SELECT t.account_id, count(*) AS n, round(regr_slope(t.r - rf, mkt_rf), 5) AS mkt_rf, round(regr_intercept(t.r - rf, mkt_rf), 6) AS alpha, round(regr_r2(t.r - rf, mkt_rf), 6) AS r2 FROM twr t JOIN fct ON fct.d = t.as_of_date WHERE mom IS NOT NULL GROUP BY ALL")
def one_factor(spark, sf_dir):
    rows = mk.factor_rows(rt.daily_twr(_nav(spark, sf_dir)), _factors(spark, sf_dir))
    return mk.factor_model(rows, ["account_id"], ("mkt_rf",)).select("account_id", "n", r("mkt_rf", 5), r("alpha", 6), r("r2", 6))


_WIN = """win AS (SELECT ticker, e, b, unnest(['1W', '1M', '3M', '6M', 'YTD', '1Y', 'ALL']) AS w, unnest([e - 7, CAST(e - INTERVAL 1 MONTH AS DATE), CAST(e - INTERVAL 3 MONTH AS DATE), CAST(e - INTERVAL 6 MONTH AS DATE), date_trunc('year', e)::DATE - 1, CAST(e - INTERVAL 12 MONTH AS DATE), b]) AS s FROM (SELECT ticker, max(price_date) AS e, min(price_date) AS b FROM v_prices GROUP BY ALL))
, st AS (SELECT win.*, coalesce((SELECT max(p.price_date) FROM v_prices p WHERE p.ticker = win.ticker AND p.price_date <= win.s), CASE WHEN b - s <= 7 THEN b END) AS sd FROM win)"""


@query("win12_price_moves", f'WITH {sql_views("v_prices")}, {_WIN} SELECT st.ticker, w AS "window", sd AS start_date, round(CAST(z.close_price AS DOUBLE) / CAST(a.close_price AS DOUBLE) - 1, 6) AS change FROM st JOIN v_prices z ON z.ticker = st.ticker AND z.price_date = st.e LEFT JOIN v_prices a ON a.ticker = st.ticker AND a.price_date = st.sd')
def price_moves(spark, sf_dir):
    return mk.price_moves(view(spark, sf_dir, "v_prices"), ["ticker"]).select("ticker", "window", "start_date", r("change"))


@query("win13_watchlist_change", f"WITH {sql_views('v_prices')}, p AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY price_date DESC) AS rn, max(price_date) OVER (PARTITION BY ticker) AS e FROM v_prices), g AS (SELECT ticker, CAST(max(close_price) FILTER (rn = 1) AS DOUBLE) AS l, CAST(max(close_price) FILTER (rn = 2) AS DOUBLE) AS d, CAST(arg_max(close_price, price_date) FILTER (price_date <= CAST(e - INTERVAL 1 MONTH AS DATE)) AS DOUBLE) AS m FROM p GROUP BY ALL) SELECT ticker, l AS last_close, round(l / d - 1, 6) AS day_change, round(l / m - 1, 6) AS month_change FROM g")
def watchlist_change(spark, sf_dir):
    return mk.watchlist_change(view(spark, sf_dir, "v_prices"), ["ticker"]).select("ticker", "last_close", r("day_change"), r("month_change"))


_BENCHMARK = [("Energy", 0.5, 0.1), ("Health Care", 0.3, 0.05), ("Utilities", 0.2, 0.02)]
_EFFECTS = pf.ORACLE_SQL["agg17_brinson"]


@query("agg18_sector_gates", f"WITH {pf.HOLD}, {pf.UNIT}, s AS (SELECT account_id, as_of_date, ticker, CAST(v AS DOUBLE) / CAST(sum(v) OVER (PARTITION BY account_id, as_of_date) AS DOUBLE) AS share FROM hold WHERE v IS NOT NULL), n AS (SELECT account_id, count(DISTINCT as_of_date) AS n FROM s GROUP BY ALL), aw AS (SELECT account_id, ticker, sum(share) / any_value(n.n) AS w FROM s JOIN n USING (account_id) GROUP BY ALL), wr AS (SELECT account_id, ticker, 1 AS has FROM u GROUP BY ALL HAVING count(*) >= 2), sec AS (SELECT ticker, sector FROM v_instruments WHERE ticker NOT LIKE '%5'), g AS (SELECT aw.account_id, sum(CASE WHEN sector IS NULL THEN w ELSE 0 END) / sum(w) AS un, bool_or(has IS NULL) AS nr FROM aw LEFT JOIN sec USING (ticker) LEFT JOIN wr USING (account_id, ticker) GROUP BY ALL) SELECT account_id, round(un, 6) AS unclassified, CASE WHEN nr THEN 'missing_return' WHEN un > 0.1 THEN 'unclassified' ELSE 'ok' END AS status FROM g")
def sector_gates(spark, sf_dir):
    h = pf.replayed(spark, sf_dir).holdings
    sectors = view(spark, sf_dir, "v_instruments").filter("ticker not like '%5'").select("ticker", "sector")
    proxies = spark.createDataFrame(_BENCHMARK, "sector string, wb double, rb double").select("sector", "rb")
    return mk.sector_gates(co.average_weights(h), co.window_returns(h), sectors, proxies).select("account_id", r("unclassified"), "status")


@query("agg19_attribution_report", f"WITH {pf.NAV}, tw AS (SELECT account_id, product(1 + r) - 1 AS g FROM twr GROUP BY ALL), ef AS ({_EFFECTS}), e AS (SELECT account_id, sum(allocation) AS al, sum(selection) AS se, sum(interaction) AS i FROM ef GROUP BY ALL) SELECT account_id, round(g - 0.069, 4) AS active, round(al, 4) AS allocation, round(se, 4) AS selection, round(i, 4) AS interaction FROM e JOIN tw USING (account_id)")
def attribution_report(spark, sf_dir):
    benchmark = spark.createDataFrame(_BENCHMARK, "sector string, wb double, rb double")
    effects = co.brinson(pf._sector_groups(spark, sf_dir), benchmark)
    report = mk.attribution_report(effects, rt.daily_twr(_nav(spark, sf_dir)), 0.069)
    return report.select("account_id", *[r(c, 4) for c in ("active", "allocation", "selection", "interaction")])


@query("win14_latest_snapshot", f"WITH {pf.HOLD} SELECT account_id, as_of_date, ticker, CAST(quantity AS DOUBLE) AS quantity FROM hold QUALIFY as_of_date = max(as_of_date) OVER (PARTITION BY account_id)")
def latest_snapshot(spark, sf_dir):
    h = pf.replayed(spark, sf_dir).holdings
    last = h.groupBy("account_id").agg(F.max("as_of_date").alias("as_of_date"))
    return h.join(last, ["account_id", "as_of_date"], "left_semi").select("account_id", "as_of_date", "ticker", F.col("quantity").cast("double").alias("quantity"))


@query("win16_growth_of_100", f"WITH {pf.NAV} SELECT account_id, as_of_date, round(level / arg_min(level, as_of_date) FILTER (level > 0) OVER (PARTITION BY account_id) * 100, 3) AS growth FROM idx")
def growth_of_100(spark, sf_dir):
    return mk.growth_of_100(rt.twr_index(_nav(spark, sf_dir))).select("account_id", "as_of_date", r("growth", 3))


@query("win18_tail", f"WITH {pf.NAV} SELECT account_id, as_of_date, {D4('nav', 'nav_eur')} FROM navs QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY as_of_date DESC) <= 30")
def tail(spark, sf_dir):
    return mk.tail(_nav(spark, sf_dir), 30).select("account_id", "as_of_date", money_out(F.col("nav_eur")).alias("nav_eur"))


@query("win19_latest_valued_nav", f"WITH {pf.NAV} SELECT account_id, max(as_of_date) AS as_of_date, {D4('arg_max(nav, as_of_date)', 'nav_eur')} FROM navs WHERE nav IS NOT NULL GROUP BY ALL")
def latest_valued_nav(spark, sf_dir):
    last = _nav(spark, sf_dir).filter("nav_eur is not null").groupBy("account_id").agg(F.max(F.struct("as_of_date", "nav_eur")).alias("l"))
    return last.select("account_id", "l.as_of_date", money_out(F.col("l.nav_eur")).alias("nav_eur"))


@query("win09_invested_to_date", f"WITH {pf.NAV}, b AS (SELECT account_id, day, sum(CASE kind WHEN 'buy' THEN eur WHEN 'sell' THEN -eur ELSE 0 END) AS x FROM ev GROUP BY ALL) SELECT n.account_id, n.as_of_date, {D4('sum(coalesce(b.x, 0)) OVER (PARTITION BY n.account_id ORDER BY n.as_of_date)', 'invested_eur')} FROM navs n LEFT JOIN b ON b.account_id = n.account_id AND b.day = n.as_of_date")
def invested_to_date(spark, sf_dir):
    rep = pf.replayed(spark, sf_dir)
    flows = rep.flows.groupBy("account_id", "as_of_date").agg(F.sum(F.col("bought_eur") - F.col("sold_eur")).alias("x"))
    run = F.sum(F.coalesce("x", F.lit(0))).over(Window.partitionBy("account_id").orderBy("as_of_date").rowsBetween(Window.unboundedPreceding, 0))
    return rep.nav.select("account_id", "as_of_date").join(flows, ["account_id", "as_of_date"], "left").select("account_id", "as_of_date", money_out(run).alias("invested_eur"))


@query("win08_running_quantity", f"WITH {pf.HOLD} SELECT account_id, ticker, as_of_date, CAST(quantity AS DOUBLE) AS quantity FROM hold WHERE ticker LIKE '%1'")
def running_quantity(spark, sf_dir):
    return pf.replayed(spark, sf_dir).holdings.filter("ticker like '%1'").select("account_id", "ticker", "as_of_date", F.col("quantity").cast("double").alias("quantity"))


@query("win01_daily_twr_open", f"WITH {pf.NAV} SELECT account_id, as_of_date, round(CAST(nav AS DOUBLE) / CAST(prev + ext AS DOUBLE) - 1, 8) AS twr FROM twr0 WHERE nav IS NOT NULL AND prev IS NOT NULL AND prev + ext <> 0")
def twr_open(spark, sf_dir):
    return rt.daily_twr(_nav(spark, sf_dir), "flow_at_open").select("account_id", "as_of_date", r("twr", 8))


@query("win06_rolling_beta_90", pf.ORACLE_SQL["win06_rolling_beta"].replace("29 PRECEDING", "89 PRECEDING").replace("n = 30", "n = 90"))
def rolling_beta_90(spark, sf_dir):
    return rt.rolling_beta(pf._joined(spark, sf_dir), 90).select("account_id", "as_of_date", r("beta", 4))


@query("agg46_instrument_detail", f"WITH {pf.EV}, pr AS (SELECT ticker, CAST(max(close_price) AS DOUBLE) AS hi, CAST(min(close_price) AS DOUBLE) AS lo FROM v_prices GROUP BY ALL) SELECT ev.account_id, ev.ticker, {D4('sum(CASE kind WHEN $$buy$$ THEN eur ELSE 0 END)', 'bought_eur')}, {D4('sum(CASE kind WHEN $$sell$$ THEN eur ELSE 0 END)', 'sold_eur')}, {D4('sum(CASE kind WHEN $$dividend$$ THEN eur ELSE 0 END)', 'dividend_eur')}, min(day) FILTER (kind = 'buy') AS first_buy, any_value(hi) AS high, any_value(lo) AS low FROM ev JOIN pr USING (ticker) WHERE kind IN ('buy', 'sell', 'dividend') GROUP BY ALL".replace("$$", "'"))
def instrument_detail(spark, sf_dir):
    e = pf.replayed(spark, sf_dir).events.filter("kind in ('buy', 'sell', 'dividend')")
    total = lambda k: money_out(F.sum(F.when(F.col("kind") == k, F.col("eur")).otherwise(0))).alias({"buy": "bought_eur", "sell": "sold_eur"}.get(k, "dividend_eur"))
    g = e.groupBy("account_id", "ticker").agg(total("buy"), total("sell"), total("dividend"), F.min(F.when(F.col("kind") == "buy", F.col("day"))).alias("first_buy"))
    p = view(spark, sf_dir, "v_prices").groupBy("ticker").agg(F.max("close_price").cast("double").alias("high"), F.min("close_price").cast("double").alias("low"))
    return g.join(p, "ticker").select("account_id", "ticker", "bought_eur", "sold_eur", "dividend_eur", "first_buy", "high", "low")


@query("agg51_period_results", f"SELECT account_id, period, result_eur, return_pct FROM ({pf.ORACLE_SQL['agg06_holding_movements']}) WHERE ticker = 'Brand#11'")
def period_results(spark, sf_dir):
    return pf.QUERIES["agg06_holding_movements"](spark, sf_dir).filter("ticker = 'Brand#11'").drop("ticker")


@query("agg07_unattributed", f"WITH s AS ({pf.ORACLE_SQL['agg04_period_summaries']}), m AS ({pf.ORACLE_SQL['agg06_holding_movements']}), g AS (SELECT account_id, period, sum(result_eur) AS x, bool_and(result_eur IS NOT NULL) AS ok FROM m GROUP BY ALL) SELECT s.account_id, s.period, round(CASE WHEN coalesce(ok, true) THEN s.result_eur - coalesce(x, 0) END, 2) AS unattributed_eur FROM s LEFT JOIN g USING (account_id, period)")
def unattributed(spark, sf_dir):
    rep = pf.replayed(spark, sf_dir)
    bounds = pe.period_bounds(rep.nav)
    out = pe.unattributed(pe.summarise(rep.nav, rt.daily_twr(rep.nav), bounds), pe.holding_movements(rep.holdings, rep.flows, bounds))
    return out.select("account_id", "period", F.round(F.col("unattributed_eur").cast("double"), 2).alias("unattributed_eur"))


@query("agg52_first_event", f"WITH {pf.EV} SELECT account_id, min(day) AS first_day FROM (SELECT account_id, day FROM v_fills UNION ALL SELECT account_id, day FROM v_dividends UNION ALL SELECT account_id, day FROM v_cash) GROUP BY ALL")
def first_event(spark, sf_dir):
    return lg.first_event_date(summed_ledger(spark, sf_dir))


@query("flt04_required_currencies", f"WITH {sql_views('v_cash', 'v_instruments')} SELECT DISTINCT upper(currency) AS currency FROM (SELECT currency FROM v_cash UNION ALL SELECT currency FROM v_instruments) WHERE currency <> 'EUR'")
def required_currencies(spark, sf_dir):
    return lg.required_currencies(ledger(spark, sf_dir))


@query("flt07_status_tickers", f"WITH {pf.HOLD} SELECT DISTINCT ticker, status AS valuation_status FROM hold WHERE status <> 'VALUED'")
def status_tickers(spark, sf_dir):
    return pf.replayed(spark, sf_dir).holdings.filter("valuation_status <> 'VALUED'").select("ticker", "valuation_status").distinct()


@query("join02_rate_within_cutoff", f"WITH {sql_views('v_cash', 'v_fx')} SELECT c.reference, CAST(CASE WHEN c.currency = 'EUR' THEN 1 WHEN c.day - x.rate_date <= {STALE} THEN x.eur_per_unit END AS DOUBLE) AS rate FROM v_cash c ASOF LEFT JOIN v_fx x ON c.currency = x.currency AND c.day >= x.rate_date")
def rate_within_cutoff(spark, sf_dir):
    cash, fx = view(spark, sf_dir, "v_cash"), lg.fx_daily(view(spark, sf_dir, "v_fx"), STALE)
    priced = lg.to_eur(cash.withColumn("one", F.lit(1).cast("decimal(28,10)")), "one", "currency", "day", fx, "rate")
    return priced.select("reference", F.col("rate").cast("double").alias("rate"))
