"""Queries over card spending, budgets, dividend rhythm and allocation planning, with SQL for the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerwell.operators import household as hh
from ledgerwell.operators import planning as pl
from ledgerwell.plans.adapters import sql_views, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
CARD, DIV = f"WITH {sql_views('v_card')}", f"WITH {sql_views('v_dividends')}"
TODAY = "2024-01-20"
DEPOSIT = 1000.0
#: Monthly limits by category and planned shares by segment.
LIMITS = [("category 0", 1000.0), ("category 1", 2000.0), ("category 2", 500.0)]
TARGETS = [("AUTOMOBILE", 0.3), ("BUILDING", 0.25), ("FURNITURE", 0.2), ("HOUSEHOLD", 0.15)]


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


@query("agg24_card_rollup", f"{CARD} SELECT CAST(date_trunc('month', day) AS DATE) AS month, category, CAST(sum(spent) AS DOUBLE) AS spent, count(*) AS n FROM v_card GROUP BY ROLLUP (1, 2)")
def card_rollup(spark, sf_dir):
    rows = view(spark, sf_dir, "v_card").withColumn("month", F.trunc("day", "month"))
    return rows.rollup("month", "category").agg(F.sum("spent").cast("double").alias("spent"), F.count("*").alias("n"))


@query("agg25_daily_buckets", f"{CARD}, e AS (SELECT merchant, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS bucket FROM v_card GROUP BY merchant) SELECT e.merchant, e.bucket, CAST(coalesce(sum(spent), 0) AS DOUBLE) AS spent, count(event_id) AS n FROM e LEFT JOIN v_card c ON c.merchant = e.merchant AND c.day = e.bucket GROUP BY ALL")
def daily_buckets(spark, sf_dir):
    return hh.buckets(view(spark, sf_dir, "v_card"), "merchant", "day").withColumn("spent", F.col("spent").cast("double"))


@query("agg25_weekly_buckets", f"{CARD}, w AS (SELECT *, CAST(date_trunc('week', day) AS DATE) AS wk FROM v_card), e AS (SELECT merchant, unnest(generate_series(min(wk), max(wk), INTERVAL 7 DAY))::DATE AS bucket FROM w GROUP BY merchant) SELECT e.merchant, e.bucket, CAST(coalesce(sum(spent), 0) AS DOUBLE) AS spent, count(event_id) AS n FROM e LEFT JOIN w c ON c.merchant = e.merchant AND c.wk = e.bucket GROUP BY ALL")
def weekly_buckets(spark, sf_dir):
    return hh.buckets(view(spark, sf_dir, "v_card"), "merchant", "week").withColumn("spent", F.col("spent").cast("double"))


@query("agg26_top_merchants", f"{CARD}, g AS (SELECT category, merchant, sum(spent) AS s, count(*) AS n, max(day) AS last_day FROM v_card GROUP BY ALL) SELECT category, merchant, CAST(s AS DOUBLE) AS spent, n, last_day, CAST(row_number() OVER (PARTITION BY category ORDER BY s DESC, merchant) AS INTEGER) AS rank FROM g QUALIFY rank <= 5")
def top_merchants(spark, sf_dir):
    g = view(spark, sf_dir, "v_card").groupBy("category", "merchant").agg(F.sum("spent").alias("s"), F.count("*").alias("n"), F.max("day").alias("last_day"))
    ranked = g.withColumn("rank", F.row_number().over(Window.partitionBy("category").orderBy(F.desc("s"), "merchant"))).filter("rank <= 5")
    return ranked.select("category", "merchant", F.col("s").cast("double").alias("spent"), "n", "last_day", "rank")


@query("agg27_merchant_weekdays", f"{CARD} SELECT merchant, CAST((dayofweek(day) + 6) % 7 AS INTEGER) AS weekday, CAST(sum(spent) AS DOUBLE) AS spent, count(*) AS n FROM v_card GROUP BY ALL")
def merchant_weekdays(spark, sf_dir):
    return view(spark, sf_dir, "v_card").groupBy("merchant", F.weekday("day").alias("weekday")).agg(F.sum("spent").cast("double").alias("spent"), F.count("*").alias("n"))


@query("win17_charge_gaps", f"{CARD} SELECT event_id, merchant, day - lag(day) OVER (PARTITION BY merchant ORDER BY ts, event_id) AS gap_days FROM v_card")
def charge_gaps(spark, sf_dir):
    before = F.lag("day").over(Window.partitionBy("merchant").orderBy("ts", "event_id"))
    return view(spark, sf_dir, "v_card").select("event_id", "merchant", F.datediff("day", before).cast("long").alias("gap_days"))


@query("agg29_budget_lines", f"{CARD}, m AS (SELECT category, sum(CASE WHEN date_trunc('month', day) = date_trunc('month', DATE '{TODAY}') THEN spent ELSE 0 END) AS s FROM v_card GROUP BY ALL), l(category, lim) AS (VALUES {', '.join(f'({c!r}, CAST({v} AS DOUBLE))' for c, v in LIMITS)}) SELECT coalesce(m.category, l.category) AS category, lim AS monthly_limit, floor(CAST(coalesce(s, 0) AS DOUBLE) * 100 + 0.5) / 100.0 AS spent, floor(floor(CAST(coalesce(s, 0) AS DOUBLE) * 100 + 0.5) / 100.0 / 20 * 31 * 100 + 0.5) / 100.0 AS projected FROM m FULL JOIN l ON m.category = l.category")
def budget_lines(spark, sf_dir):
    limits = spark.createDataFrame(LIMITS, "category string, monthly_limit double")
    return hh.budget_lines(view(spark, sf_dir, "v_card"), limits, TODAY)


@query("agg31_dividend_rhythm", f"{DIV}, d AS (SELECT DISTINCT account_id, ticker, day FROM v_dividends), k AS (SELECT *, row_number() OVER (PARTITION BY account_id, ticker ORDER BY day DESC) AS rn, day - lag(day) OVER (PARTITION BY account_id, ticker ORDER BY day) AS gap FROM d), g AS (SELECT account_id, ticker, CAST(median(gap) FILTER (rn <= 7) AS DOUBLE) AS median_gap FROM k GROUP BY ALL) SELECT account_id, ticker, median_gap, CASE WHEN median_gap BETWEEN 25 AND 40 THEN 12 WHEN median_gap BETWEEN 80 AND 105 THEN 4 WHEN median_gap BETWEEN 160 AND 200 THEN 2 WHEN median_gap BETWEEN 330 AND 400 THEN 1 END AS per_year FROM g")
def dividend_rhythm(spark, sf_dir):
    return hh.payment_rhythm(view(spark, sf_dir, "v_dividends"), ["account_id", "ticker"], "day")


POSITIONS = f"p AS (SELECT c_nationkey AS account_id, c_mktsegment AS ticker, CAST(sum(CAST(c_acctbal AS DECIMAL(14,2))) AS DOUBLE) AS value FROM customer GROUP BY ALL), t(ticker, target) AS (VALUES {', '.join(f'({c!r}, CAST({v} AS DOUBLE))' for c, v in TARGETS)})"


@query("sim04_plan_allocation", f"WITH {POSITIONS}, a AS (SELECT p.*, target / sum(target) OVER w AS share, sum(greatest(value, 0)) OVER w AS planned FROM p JOIN t USING (ticker) WINDOW w AS (PARTITION BY account_id)), s AS (SELECT *, greatest(share * (planned + {DEPOSIT}) - value, 0) AS shortfall FROM a), b AS (SELECT *, CASE WHEN sum(shortfall) OVER (PARTITION BY account_id) > 0 THEN {DEPOSIT} * shortfall / sum(shortfall) OVER (PARTITION BY account_id) ELSE 0 END AS buy FROM s) SELECT account_id, ticker, round(CASE WHEN planned > 0 THEN value / planned ELSE 0 END - share, 6) AS drift, round(buy, 4) AS buy, round((value + buy) / (planned + {DEPOSIT}), 6) AS weight_after, round(share * planned - value, 4) AS full_trade FROM b")
def plan_allocation(spark, sf_dir):
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    positions = customers.groupBy(F.col("c_nationkey").alias("account_id"), F.col("c_mktsegment").alias("ticker")).agg(F.sum(F.col("c_acctbal").cast("decimal(14,2)")).cast("double").alias("value"))
    targets = spark.createDataFrame(TARGETS, "ticker string, target double")
    p = hh.plan_allocation(positions, targets, DEPOSIT)
    return p.select("account_id", "ticker", F.round("drift", 6).alias("drift"), F.round("buy", 4).alias("buy"), F.round("weight_after", 6).alias("weight_after"), F.round("full_trade", 4).alias("full_trade"))


@query("sim02_future_value", "WITH g AS (SELECT c_custkey, c_acctbal AS v, c_custkey % 120 AS m, power(1 + (c_custkey % 8) / 100.0, 1 / 12.0) - 1 AS rt FROM customer) SELECT c_custkey, round(CASE WHEN m <= 0 THEN v WHEN abs(rt) < 1e-12 THEN v + 10.0 * m ELSE v * power(1 + rt, m) + 10.0 * ((power(1 + rt, m) - 1) / rt) END, 4) AS future_value, round(CASE WHEN m > 0 THEN CASE WHEN 20000 - v * power(1 + rt, m) <= 0 THEN 0 WHEN abs(rt) < 1e-12 THEN (20000 - v * power(1 + rt, m)) / m ELSE (20000 - v * power(1 + rt, m)) * rt / (power(1 + rt, m) - 1) END END, 4) AS required_monthly FROM g")
def future_value(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_acctbal", (F.col("c_custkey") % 120).alias("months"), ((F.col("c_custkey") % 8) / 100.0).alias("yearly"))
    value, required = hh.future_value(F.col("c_acctbal"), F.lit(10.0), F.col("yearly"), F.col("months")), hh.required_monthly(F.col("c_acctbal"), F.lit(20000.0), F.col("yearly"), F.col("months"))
    return c.select("c_custkey", F.round(value, 4).alias("future_value"), F.round(required, 4).alias("required_monthly"))




#: Charges one after another: each joins the first cluster whose median is about its amount.
_CLUSTERS = f"""c AS (SELECT user_id, merchant, ts, CAST(spent AS DOUBLE) AS a, row_number() OVER (PARTITION BY user_id, merchant ORDER BY ts, spent) AS rn FROM v_card WHERE spent > 0),
s AS (SELECT DISTINCT user_id, merchant, CAST(0 AS BIGINT) AS rn, CAST([] AS DOUBLE[][]) AS cl, CAST(0 AS BIGINT) AS home FROM c UNION ALL
  SELECT user_id, merchant, c_rn, CASE WHEN h > len(cl) THEN list_append(cl, [a]) ELSE list_transform(cl, lambda x, i: CASE WHEN i = h THEN list_append(x, a) ELSE x END) END, h
  FROM (SELECT s.user_id, s.merchant, s.cl, c.rn AS c_rn, c.a, coalesce(nullif(list_position(list_transform(s.cl, lambda x: abs(c.a - list_aggregate(x, 'median')) <= list_aggregate(x, 'median') * {pl.SAME_AMOUNT}), true), 0), len(s.cl) + 1) AS h FROM s JOIN c ON c.user_id = s.user_id AND c.merchant = s.merchant AND c.rn = s.rn + 1)),
m AS (SELECT c.*, home, epoch_us(ts) / 86400e6 AS day FROM c JOIN s USING (user_id, merchant, rn)),
gp AS (SELECT *, day - lag(day) OVER (PARTITION BY user_id, merchant, home ORDER BY ts, a) AS gap FROM m),
k AS (SELECT user_id, merchant, home, count(*) AS n, median(gap) AS beat, min(gap) AS least, list(gap) FILTER (gap IS NOT NULL) AS gaps, list(a ORDER BY ts, a) AS amounts, min(ts) AS first, max(ts) AS last FROM gp GROUP BY ALL HAVING count(*) >= 2),
q AS (SELECT *, amounts[-1] AS latest, amounts[-2] AS before, epoch_us(TIMESTAMP '2024-02-01') / 86400e6 AS now_day, CASE {' '.join(f"WHEN beat BETWEEN {lo} AND {hi} THEN '{name}'" for lo, hi, name, _ in pl.CADENCES)} ELSE concat('Every ~', CAST(floor(beat + 0.5) AS BIGINT), ' days') END AS cadence,
  CASE {' '.join(f"WHEN beat BETWEEN {lo} AND {hi} THEN CAST({rate!r} AS DOUBLE)" for lo, hi, _, rate in pl.CADENCES)} ELSE {pl.DAYS_PER_MONTH} / beat END AS rate FROM k
  WHERE least >= {pl.LEAST_GAP} AND CASE WHEN n = 2 THEN beat BETWEEN 26 AND 35 OR beat BETWEEN 340 AND 390 ELSE beat BETWEEN {pl.REGULAR_GAPS[0]} AND {pl.REGULAR_GAPS[1]} AND len(list_filter(gaps, lambda z: abs(z - beat) <= beat * {pl.OFF_BEAT})) >= ceil((n - 1) * {pl.REGULAR_SHARE}) END)"""


@query("agg28_recurring_charges", f"""WITH RECURSIVE {sql_views('v_card')}, {_CLUSTERS} SELECT user_id, merchant, cadence, round(beat, 6) AS interval_days, round(latest, 2) AS amount, CASE WHEN abs(latest - before) >= 0.01 THEN round(before, 2) END AS previous_amount, floor(latest * rate * 100 + 0.5) / 100 AS monthly_cost, n,
 strftime(first, '%Y-%m-%d %H:%M:%S') AS first, strftime(last, '%Y-%m-%d %H:%M:%S') AS last, strftime(CASE cadence WHEN 'Monthly' THEN date_trunc('month', last) + INTERVAL 1 MONTH + (last - date_trunc('month', last)) WHEN 'Yearly' THEN date_trunc('month', last) + INTERVAL 12 MONTH + (last - date_trunc('month', last)) ELSE last + CAST(floor(beat * 86400000) AS BIGINT) * INTERVAL '1' MILLISECOND END, '%Y-%m-%d %H:%M:%S') AS next,
 CASE WHEN now_day - epoch_us(last) / 86400e6 > beat * {pl.OVERDUE} THEN 'lapsed' WHEN latest > before * {pl.DEARER} THEN 'price-up' WHEN n = 2 AND now_day - epoch_us(first) / 86400e6 < beat * {pl.YOUNG} THEN 'new' ELSE 'active' END AS status FROM q""")
def recurring_charges(spark, sf_dir):
    card = view(spark, sf_dir, "v_card").select("user_id", "merchant", "ts", F.col("spent").cast("double").alias("amount"))
    found = pl.recurring(card, ["user_id", "merchant"], "2024-02-01").withColumn("interval_days", F.round("interval_days", 6))
    return found.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first", "last", "next")})


_DRAW = "CAST(xor(u, u >> 14) AS DOUBLE) / 4294967296.0 FROM (SELECT xor(t, (t + (xor(t, t >> 7) * (t | 61) & 4294967295)) & 4294967295) AS u FROM (SELECT (xor(s, s >> 15) * (s | 1)) & 4294967295 AS t FROM (SELECT CAST(({seed} + ({k} + 1) * {step}) & 4294967295 AS UBIGINT) AS s)))"
_SIM = f"""WITH p AS (SELECT n_nationkey, n_nationkey * 1000.0::DOUBLE AS start, n_nationkey / 300.0::DOUBLE AS yearly, CAST(0.15 AS DOUBLE) / sqrt(12) AS sigma FROM nation),
d AS (SELECT i AS path, m, greatest((SELECT {_DRAW.format(seed=pl.SEED, step=pl.STEP, k=f'(2 * ((m - 1) * {pl.PATHS} + i))')}), 1e-12) AS u, (SELECT {_DRAW.format(seed=pl.SEED, step=pl.STEP, k=f'(2 * ((m - 1) * {pl.PATHS} + i) + 1)')}) AS v FROM range({pl.PATHS}) a(i), range(1, 61) b(m)),
g AS (SELECT n_nationkey, path, m, start, sum(ln(1 + yearly) / 12 - sigma * sigma / 2 + sigma * sqrt(-2 * ln(u)) * cos(2 * pi() * v)) OVER (PARTITION BY n_nationkey, path ORDER BY m) AS lg FROM p, d),
w AS (SELECT n_nationkey, m AS month, start, exp(lg) * start + 100 * exp(lg) * sum(exp(-lg)) OVER (PARTITION BY n_nationkey, path ORDER BY m) AS val FROM g UNION ALL SELECT n_nationkey, 0, start, start FROM p, range({pl.PATHS}))"""


@query("sim01_value_ranges", f"{_SIM} SELECT n_nationkey, CAST(month AS INTEGER) AS month, round(quantile_cont(val, 0.1), 2) AS low, round(quantile_cont(val, 0.5), 2) AS median, round(quantile_cont(val, 0.9), 2) AS high, any_value(start) + 100.0 * month AS contributed FROM w GROUP BY n_nationkey, month")
def value_ranges(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/nation.parquet")
    plans = c.select("n_nationkey", (F.col("n_nationkey") * 1000).alias("start"), F.lit(100).alias("monthly"), (F.col("n_nationkey") / 300).alias("yearly"), F.lit(0.15).alias("volatility"), F.lit(5).alias("years"))
    return pl.value_ranges(plans, "n_nationkey").withColumns({c: F.round(c, 2) for c in ("low", "median", "high")})
