"""Queries that run as streams or over logs of states, with SQL for the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerwell.functions.money import QTY
from ledgerwell.functions.storage import new_path
from ledgerwell.plans.adapters import sql_views, view
from ledgerwell.streaming import events as st
from ledgerwell.streaming import stateful, upkeep

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Which state of a thesis may follow which.
MOVES = (("draft", "active"), ("active", "validated"), ("active", "invalidated"), ("validated", "closed"), ("invalidated", "closed"))
STATES = ("draft", "active", "validated", "invalidated", "closed")


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def _events(spark, sf_dir) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    # the files keep no zone: their times are those of the session, UTC as everywhere here
    return st.read_events(spark, f"{sf_dir}/[e]vents.parquet", schema).withColumn("ts", F.col("ts").cast("timestamp")).withColumn("amount", F.col("value").cast("decimal(14,2)"))


@query("stm04_streamed_days", "SELECT event_type, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, CAST(sum(CAST(value AS DECIMAL(14,2))) AS DOUBLE) AS total, count(*) AS n FROM events GROUP BY ALL")
def streamed_days(spark, sf_dir):
    sums = st.window_sums(_events(spark, sf_dir), ["event_type"], "ts", "amount", "1 day")
    out = st.run_updates(sums, ["event_type", "window_start"], "days")
    return out.select("event_type", F.date_format("window_start", "yyyy-MM-dd").alias("day"), F.col("total").cast("double").alias("total"), "n")


@query("stm04_streamed_weeks", "SELECT event_type, strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, CAST(sum(CAST(value AS DECIMAL(14,2))) AS DOUBLE) AS total, count(*) AS n FROM events GROUP BY ALL")
def streamed_weeks(spark, sf_dir):
    # windows count from a Thursday; four days later they begin on Mondays
    sums = st.window_sums(_events(spark, sf_dir), ["event_type"], "ts", "amount", "7 days", "7 days", "4 days")
    out = st.run_updates(sums, ["event_type", "window_start"], "weeks")
    return out.select("event_type", F.date_format("window_start", "yyyy-MM-dd").alias("week"), F.col("total").cast("double").alias("total"), "n")


@query("stm05_streamed_sliding", "SELECT event_type, strftime(date_trunc('day', ts) - to_days(CAST(k AS INTEGER)), '%Y-%m-%d') AS first_day, count(*) AS n FROM events, range(30) t(k) GROUP BY ALL")
def streamed_sliding(spark, sf_dir):
    sums = st.window_sums(_events(spark, sf_dir), ["event_type"], "ts", "amount", "30 days", "1 day")
    out = st.run_updates(sums, ["event_type", "window_start"], "sliding")
    return out.select("event_type", F.date_format("window_start", "yyyy-MM-dd").alias("first_day"), "n")


@query("stm08_once_only_alerts", "SELECT DISTINCT concat('alert:', CAST(user_id AS VARCHAR)) AS message FROM events WHERE value >= 90")
def once_only_alerts(spark, sf_dir):
    key = F.concat(F.lit("alert:"), F.col("user_id").cast("string"))
    return st.run_appends(st.once_only(_events(spark, sf_dir), key, F.col("value") >= 90, "ts"), "alerts")


@query("stm09_daily_messages", "SELECT DISTINCT concat('daily:', strftime(ts, '%Y-%m-%d'), ':', event_type) AS message FROM events WHERE value IS NOT NULL")
def daily_messages(spark, sf_dir):
    key = F.concat(F.lit("daily:"), F.date_format("ts", "yyyy-MM-dd"), F.lit(":"), F.col("event_type"))
    return st.run_appends(st.once_a_period(_events(spark, sf_dir), key, F.col("value").isNotNull(), "ts"), "daily")


_LOG = f"SELECT o_custkey, o_orderkey, CASE o_orderkey % 5 {' '.join(f'WHEN {i} THEN {s!r}' for i, s in enumerate(STATES))} END AS state, lag(CASE o_orderkey % 5 {' '.join(f'WHEN {i} THEN {s!r}' for i, s in enumerate(STATES))} END) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders"


@query("stm15_refused_transitions", f"SELECT o_custkey, o_orderkey, before, state FROM ({_LOG}) WHERE before IS NOT NULL AND before <> state AND (before, state) NOT IN ({', '.join(str(m) for m in MOVES)})")
def refused_transitions(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    state = F.element_at(F.array(*[F.lit(s) for s in STATES]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    log = o.select("o_custkey", "o_orderkey", "o_orderdate", state.alias("state")).withColumn("before", F.lag("state").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")))
    allowed = F.lit(False)
    for a, b in MOVES:
        allowed = allowed | ((F.col("before") == a) & (F.col("state") == b))
    return log.filter(F.col("before").isNotNull() & (F.col("before") != F.col("state")) & ~allowed).select("o_custkey", "o_orderkey", "before", "state")


@query("stm11_due_fetches", "WITH l AS (SELECT o_custkey, max(CAST(o_orderdate AS DATE)) AS last_fetch FROM orders GROUP BY ALL) SELECT o_custkey, last_fetch FROM l WHERE last_fetch <= DATE '1998-08-01' - 7 ORDER BY last_fetch, o_custkey LIMIT 4")
def due_fetches(spark, sf_dir):
    last = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_custkey").agg(F.max(F.col("o_orderdate").cast("date")).alias("last_fetch"))
    return last.filter(F.col("last_fetch") <= F.date_sub(F.lit("1998-08-01").cast("date"), 7)).orderBy("last_fetch", "o_custkey").limit(4)


@query("stm14_pending_deliveries", "SELECT event_id FROM events WHERE event_type = 'error' AND ts > (SELECT max(ts) FROM events) - INTERVAL 24 HOUR")
def pending_deliveries(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    now = e.agg(F.max("ts")).first()[0]
    return e.filter((F.col("event_type") == "error") & (F.col("ts") > F.lit(now) - F.expr("interval 24 hours"))).select("event_id")


@query("stm10_export_steps")
def export_steps(spark, sf_dir):
    state = F.when(F.col("event_type") == "purchase", "Finished").when(F.col("event_type") == "error", "Failed").when(F.col("event_type") == "view", "Running")
    steps = _events(spark, sf_dir).select(F.col("user_id").cast("string").alias("account_id"), F.col("ts").alias("at"), state.alias("status"), (F.col("event_id") % 4 > 0).alias("has_link"))
    return st.run_appends(stateful.export_steps(steps), "export-steps")


@query("stm06_stories_once")
def stories_once(spark, sf_dir):
    e = _events(spark, sf_dir)
    hour = F.col("ts") - F.expr("make_interval(0, 0, 0, 0, cast(event_id % 30 as int))")
    items = e.select(F.col("event_id").alias("item_id"), F.concat(F.lit("u"), (F.col("event_id") - F.col("event_id") % 3).cast("string")).alias("canonical"), F.concat(F.lit("t"), (F.col("user_id") % 50).cast("string")).alias("title"), F.when(F.col("event_id") % 40 > 0, hour).alias("ts"), F.col("ts").alias("fetched_at"))
    return st.run_appends(stateful.stories_once(items), "stories").select("item_id", "title")


@query("stm07_late_fills", f"WITH {sql_views('v_fills')}, d AS (SELECT account_id, ticker, day, sum(CASE side WHEN 'BUY' THEN quantity ELSE -quantity END) AS delta FROM v_fills GROUP BY ALL) SELECT account_id, ticker, strftime(day, '%Y-%m-%d') AS day, CAST(sum(delta) OVER (PARTITION BY account_id, ticker ORDER BY day) AS DOUBLE) AS quantity FROM d")
def late_fills(spark, sf_dir):
    signed = F.when(F.col("side") == "BUY", F.col("quantity")).otherwise(-F.col("quantity"))
    trades = view(spark, sf_dir, "v_fills").select("account_id", "ticker", "day", signed.cast(QTY).alias("delta"), F.col("quantity"))
    late = (F.col("day") >= "1998-03-01") & (F.col("quantity") % 5 == 0)
    folder = new_path(spark, "levels")
    upkeep.write_levels(trades.filter(~late).select("account_id", "ticker", "day", "delta"), folder)
    upkeep.add_late(spark, folder, trades.filter(late).select("account_id", "ticker", "day", "delta"))
    return upkeep.levels(spark, folder).select("account_id", "ticker", F.date_format("day", "yyyy-MM-dd").alias("day"), F.col("quantity").cast("double").alias("quantity"))
