"""Queries over messages and the calendar, with SQL for the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwell.operators import agenda as ag
from ledgerwell.operators import messages as ms
from ledgerwell.operators.household import CADENCES, RHYTHM_WINDOW
from ledgerwell.plans.feeds import _PLAIN

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
NOW = "2024-01-20 12:00:00"


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


VIEWS = {
    "results": "SELECT o_custkey AS account_id, concat('K', CAST(o_orderkey % 12 AS VARCHAR(9))) AS ticker, CASE WHEN o_custkey % 7 > 0 THEN sum(CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END * CAST(floor(o_totalprice / 1000) AS DECIMAL(14,2))) END AS result FROM {orders} GROUP BY o_custkey, o_orderkey % 12",
    "news": f"SELECT page_id AS place, page_id % 500 AS account_id, CASE WHEN page_id % 9 > 0 THEN concat('K', CAST(page_id % 12 AS VARCHAR(9))) END AS ticker, CASE WHEN page_id % 10 > 0 THEN TIMESTAMP '{NOW}' - page_id % 15 * INTERVAL '1' DAY END AS ts, url AS headline, concat('source ', CAST(page_id % 3 AS VARCHAR(9))) AS source FROM {{pages}}",
    "cards": "SELECT user_id AS account_id, CAST(event_id AS VARCHAR(20)) AS row_id, CAST(ts AS TIMESTAMP) AS ts, CASE event_id % 4 WHEN 0 THEN 'Card debit' WHEN 1 THEN 'Card cashback' WHEN 2 THEN 'card payment' ELSE 'Withdrawal' END AS action, CASE WHEN event_id % 13 > 0 THEN -CAST(value AS DECIMAL(14,2)) END AS total, CASE WHEN event_id % 7 > 0 THEN concat('merchant ', CAST(event_id % 9 AS VARCHAR(9))) END AS merchant, CASE WHEN event_id % 5 > 0 THEN concat('c', CAST(event_id % 4 AS VARCHAR(9))) ELSE '' END AS category FROM {events} WHERE event_type <> 'signup'",
    "budgets": "SELECT c_custkey AS account_id, CASE c_custkey % 3 WHEN 0 THEN 'UNCATEGORISED' WHEN 1 THEN 'c0' ELSE 'c2' END AS category, CAST(c_acctbal AS DECIMAL(14,2)) AS monthly_limit FROM {customer}",
    "alerts": "SELECT user_id AS account_id, concat('alert ', CAST(event_id AS VARCHAR(20))) AS title, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS created_at FROM {events} WHERE event_type = 'signup'",
    "moves": "SELECT user_id AS account_id, CAST(event_id + event_id % 2 AS VARCHAR(20)) AS reference, CAST(ts AS TIMESTAMP) AS ts, CASE event_id % 3 WHEN 0 THEN 'withdraw' WHEN 1 THEN 'WITHDRAWAL' ELSE 'DEPOSIT' END AS transaction_type, -CAST(value AS DECIMAL(14,2)) AS amount FROM {events}",
}
_TABLES = {"results": "orders", "news": "pages", "cards": "events", "budgets": "customer", "alerts": "events", "moves": "events"}
_WITH = "WITH " + ", ".join(f"{k} AS ({_PLAIN(v)})" for k, v in VIEWS.items())
_PAID = "paid AS (SELECT *, -total AS spent FROM cards WHERE starts_with(lower(trim(action)), 'card ') AND NOT contains(lower(action), 'cashback') AND total IS NOT NULL)"


def _view(spark, sf_dir, name) -> DataFrame:
    return spark.sql(VIEWS[name], **{_TABLES[name]: spark.read.parquet(f"{sf_dir}/{_TABLES[name]}.parquet")})


@query("agg41_weekly_payload", f"""{_WITH}, {_PAID}, t AS (SELECT TIMESTAMP '{NOW}' AS now),
movers AS (SELECT account_id, row_number() OVER (PARTITION BY account_id ORDER BY abs(result) DESC, ticker) AS rank, ticker, result FROM results WHERE result IS NOT NULL QUALIFY rank <= 6),
told AS (SELECT ticker, row_number() OVER (PARTITION BY ticker ORDER BY place) AS rank, headline, source, strftime(ts, '%Y-%m-%d') AS day FROM news, t WHERE ticker IS NOT NULL AND ts >= now - INTERVAL 7 DAY QUALIFY rank <= 3),
week AS (SELECT account_id, sum(CASE WHEN ts >= now - INTERVAL 7 DAY AND ts < now THEN spent ELSE 0 END) AS a, sum(CASE WHEN ts >= now - INTERVAL 14 DAY AND ts < now - INTERVAL 7 DAY THEN spent ELSE 0 END) AS b FROM paid, t GROUP BY account_id),
shops AS (SELECT account_id, coalesce(merchant, 'Unknown') AS merchant, sum(spent) AS spent FROM paid, t WHERE ts >= now - INTERVAL 7 DAY AND ts < now GROUP BY ALL),
month AS (SELECT account_id, coalesce(nullif(category, ''), 'UNCATEGORISED') AS category, sum(spent) AS spent FROM paid, t WHERE ts >= date_trunc('month', now) GROUP BY ALL),
x AS (SELECT account_id, 'mover' AS part, rank, ticker AS item, result AS amount, NULL AS detail FROM movers
 UNION ALL SELECT account_id, 'story', told.rank, headline, NULL, concat_ws(' ', ticker, source, day) FROM movers JOIN told USING (ticker)
 UNION ALL SELECT account_id, 'spending', 1, 'last_7_days', a, NULL FROM week UNION ALL SELECT account_id, 'spending', 1, 'previous_7_days', b, NULL FROM week
 UNION ALL SELECT * FROM (SELECT account_id, 'merchant', row_number() OVER (PARTITION BY account_id ORDER BY spent DESC, merchant) AS rank, merchant, spent, NULL FROM shops QUALIFY rank <= 5)
 UNION ALL SELECT b.account_id, 'budget', 1, b.category, coalesce(spent, 0), CAST(monthly_limit AS VARCHAR) FROM budgets b LEFT JOIN month m ON m.account_id = b.account_id AND m.category = b.category
 UNION ALL SELECT account_id, 'alert', row_number() OVER (PARTITION BY account_id ORDER BY created_at, title), title, NULL, strftime(created_at, '%Y-%m-%d %H:%M:%S') FROM alerts, t WHERE created_at >= now - INTERVAL 7 DAY)
SELECT account_id, part, CAST(rank AS INTEGER) AS rank, item, CAST(amount AS DOUBLE) AS amount, detail FROM x""")
def weekly_payload(spark, sf_dir):
    v = {name: _view(spark, sf_dir, name) for name in VIEWS}
    out = ms.weekly_payload(v["results"], v["news"], v["cards"], v["budgets"], v["alerts"], F.lit(NOW).cast("timestamp"))
    return out.withColumn("amount", F.col("amount").cast("double"))


@query("agg42_daily_facts", f"""{_WITH}, t AS (SELECT TIMESTAMP '2024-01-20' AS day), r AS (SELECT * FROM results WHERE result IS NOT NULL),
b AS (SELECT account_id, ticker, result FROM r QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY result DESC, ticker) = 1), w AS (SELECT account_id, ticker, result FROM r QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY result, ticker) = 1),
c AS (SELECT account_id, row_id, total FROM cards, t WHERE ts >= day AND starts_with(lower(action), 'card ') AND total IS NOT NULL),
o AS (SELECT account_id, reference, amount FROM moves, t WHERE ts >= day AND upper(transaction_type) IN ('WITHDRAW', 'WITHDRAWAL')),
p AS (SELECT account_id, sum(-x) AS card_spent, count(*) AS card_payments FROM (SELECT account_id, total AS x FROM c UNION ALL SELECT account_id, amount FROM o WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.account_id = o.account_id AND c.row_id = o.reference)) GROUP BY ALL),
n AS (SELECT account_id, count(*) AS stories FROM news, t WHERE ts >= day GROUP BY ALL), a AS (SELECT account_id FROM b UNION SELECT account_id FROM p UNION SELECT account_id FROM n)
SELECT a.account_id, b.ticker AS best, CAST(b.result AS DOUBLE) AS best_result, w.ticker AS worst, CAST(w.result AS DOUBLE) AS worst_result, CAST(coalesce(card_spent, 0) AS DOUBLE) AS card_spent, coalesce(card_payments, 0) AS card_payments, coalesce(stories, 0) AS stories
FROM a LEFT JOIN b USING (account_id) LEFT JOIN w USING (account_id) LEFT JOIN p USING (account_id) LEFT JOIN n USING (account_id)""")
def daily_facts(spark, sf_dir):
    v = {name: _view(spark, sf_dir, name) for name in VIEWS}
    out = ms.daily_facts(v["results"], v["cards"], v["moves"], v["news"], F.lit("2024-01-20").cast("timestamp"))
    return out.withColumns({c: F.col(c).cast("double") for c in ("best_result", "worst_result", "card_spent")})


TODAY = "1997-06-11"
_POSITIONS = "SELECT o_custkey AS account_id, o_orderdate - o_orderkey % 2 * INTERVAL '1' DAY AS ts, concat('K', CAST(o_orderkey % 300 AS VARCHAR(9))) AS ticker FROM {orders}"
_WATCH = "SELECT c_custkey AS account_id, concat('K', CAST(c_custkey % 290 AS VARCHAR(9))) AS ticker FROM {customer}"
_DECLARED = "SELECT concat('K', CAST(p_partkey % 310 AS VARCHAR(9))) AS ticker, CASE WHEN p_partkey % 10 > 0 THEN DATE '1997-04-01' + CAST(p_partkey * 13 % 400 AS INTEGER) END AS ex_date, CASE WHEN p_partkey % 3 > 0 THEN DATE '1997-04-20' + CAST(p_partkey * 13 % 400 AS INTEGER) END AS payment_date, CAST(p_size AS DECIMAL(10,2)) AS amount FROM {part} WHERE p_partkey % 310 < 200"
_EARNINGS = "SELECT concat('K', CAST(s_suppkey % 310 AS VARCHAR(9))) AS ticker, DATE '1997-03-01' + CAST(s_suppkey * 7 % 300 AS INTEGER) AS report_date FROM {supplier}"
_CALENDAR = f"""WITH p AS ({_PLAIN(_POSITIONS)}), f AS (SELECT account_id, ticker FROM p WHERE ts = (SELECT max(ts) FROM p q WHERE q.account_id = p.account_id) UNION SELECT * FROM ({_PLAIN(_WATCH)})),
e AS (SELECT ticker, ex_date AS day, 'ex_dividend' AS kind FROM ({_PLAIN(_DECLARED)}) WHERE ex_date IS NOT NULL UNION SELECT ticker, report_date, 'earnings' FROM ({_PLAIN(_EARNINGS)}) WHERE report_date >= DATE '{TODAY}' - 62),
c AS (SELECT DISTINCT account_id, ticker, CAST(day AS DATE) AS day, kind FROM f JOIN e USING (ticker))"""


def _calendar(spark, sf_dir) -> DataFrame:
    read = lambda sql, name: spark.sql(sql, **{name: spark.read.parquet(f"{sf_dir}/{name}.parquet")})
    follow = ag.followed(read(_POSITIONS, "orders"), read(_WATCH, "customer"))
    return ag.calendar_events(follow, read(_DECLARED, "part"), read(_EARNINGS, "supplier"), F.lit(TODAY).cast("date"), 62)


@query("join24_calendar_events", f"{_CALENDAR} SELECT account_id, ticker, strftime(day, '%Y-%m-%d') AS day, kind FROM c")
def calendar_events(spark, sf_dir):
    return _calendar(spark, sf_dir).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("agg54_agenda", f"{_CALENDAR}, g AS (SELECT *, CASE WHEN day = DATE '{TODAY}' THEN 'today' WHEN day <= DATE '{TODAY}' + 4 THEN 'week' WHEN day <= DATE '{TODAY}' + 11 THEN 'next' ELSE strftime(day, '%Y-%m') END AS grp FROM c WHERE day >= DATE '{TODAY}' AND kind <> 'earnings') SELECT account_id, ticker, grp AS \"group\", CAST(row_number() OVER (PARTITION BY account_id, grp ORDER BY day, ticker, kind) AS INTEGER) AS place FROM g")
def agenda(spark, sf_dir):
    return ag.agenda(ag.of_kind(_calendar(spark, sf_dir), "dividends"), F.lit(TODAY).cast("date")).select("account_id", "ticker", "group", "place")


_OWN = "SELECT concat('K', CAST(l_partkey % 400 AS VARCHAR(9))) AS ticker, CASE WHEN l_linenumber < 6 THEN CAST(l_shipdate AS TIMESTAMP) END AS paid_on, CASE WHEN l_orderkey % 5 > 0 THEN CAST(l_tax * 100 AS DECIMAL(10,2)) END AS per_share FROM {lineitem} WHERE l_partkey % 400 > 100"


@query("agg49_rhythm", f"""WITH own AS ({_PLAIN(_OWN)}), d AS ({_PLAIN(_DECLARED)}), r AS (SELECT ticker, 'declared' AS source, coalesce(payment_date, ex_date) AS day, amount, ex_date AS o FROM d UNION ALL SELECT ticker, 'history', CAST(paid_on AS DATE), per_share, CAST(paid_on AS DATE) FROM own WHERE paid_on IS NOT NULL AND ticker NOT IN (SELECT ticker FROM d)),
l AS (SELECT ticker, source, max(o) AS o, count(*) FILTER (source = 'declared' OR amount IS NOT NULL) AS payments FROM r GROUP BY ALL), last AS (SELECT r.ticker, max(amount) AS amount FROM r JOIN l ON l.ticker = r.ticker AND r.o = l.o GROUP BY r.ticker),
days AS (SELECT ticker, day, row_number() OVER (PARTITION BY ticker ORDER BY day DESC) AS rn, day - lag(day) OVER (PARTITION BY ticker ORDER BY day) AS gap FROM (SELECT DISTINCT ticker, day FROM r WHERE day IS NOT NULL)),
m AS (SELECT ticker, median(gap) FILTER (rn < {RHYTHM_WINDOW}) AS gap FROM days GROUP BY ticker)
SELECT a.ticker, coalesce(l.source, 'none') AS source, CASE {' '.join(f'WHEN gap BETWEEN {low} AND {high} THEN {n}' for low, high, n in CADENCES)} END AS per_year, CAST(last.amount AS DOUBLE) AS last_amount, coalesce(l.payments, 0) AS payments
FROM (SELECT ticker FROM own UNION SELECT ticker FROM d) a LEFT JOIN l USING (ticker) LEFT JOIN last USING (ticker) LEFT JOIN m USING (ticker)""")
def rhythm(spark, sf_dir):
    read = lambda sql, name: spark.sql(sql, **{name: spark.read.parquet(f"{sf_dir}/{name}.parquet")})
    return ag.rhythm(read(_OWN, "lineitem"), read(_DECLARED, "part")).withColumn("last_amount", F.col("last_amount").cast("double"))


@query("prj22_pending_rows", f"{_WITH} SELECT account_id, concat('pending-', reference) AS row_id, CAST(amount AS DOUBLE) AS amount, 'Not labelled yet' AS merchant, strftime(date_trunc('week', ts), '%Y-%m-%d') AS week FROM moves WHERE transaction_type <> 'DEPOSIT' AND NOT EXISTS (SELECT 1 FROM cards c WHERE c.account_id = moves.account_id AND c.row_id = moves.reference)")
def pending_rows(spark, sf_dir):
    moves, cards = _view(spark, sf_dir, "moves"), _view(spark, sf_dir, "cards")
    unlabelled = moves.filter("transaction_type <> 'DEPOSIT'").join(cards.select("account_id", F.col("row_id").alias("reference")), ["account_id", "reference"], "left_anti").withColumn("currency", F.lit("EUR"))
    rows = ag.pending_rows(unlabelled)
    return rows.select("account_id", "row_id", F.col("amount").cast("double").alias("amount"), "merchant", ag.bucket_key(F.date_format("ts", "yyyy-MM-dd"), "week").alias("week"))
