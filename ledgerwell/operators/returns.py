"""Returns and risk over daily NAV rows, for all accounts at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerwell.functions.money import ANNUAL, ratio


def by_day():
    return Window.partitionBy("account_id").orderBy("as_of_date")


def up_to():
    return by_day().rowsBetween(Window.unboundedPreceding, 0)


def daily_twr(nav: DataFrame, timing: str = "flow_at_close") -> DataFrame:
    """(account_id, as_of_date, twr): adjacent calendar rows only; none where either NAV is null or the base is zero."""
    before, flow, now = F.lag("nav_eur").over(by_day()), F.col("external_flow_eur"), F.col("nav_eur")
    top, base = {"flow_at_close": (now - flow, before), "flow_at_open": (now, before + flow), "split": (now - flow, before + flow / 2)}[timing]
    return nav.withColumn("twr", ratio(top, base) - 1).filter("twr is not null").select("account_id", "as_of_date", "twr")


def twr_index(nav: DataFrame, timing: str = "flow_at_close") -> DataFrame:
    """(account_id, as_of_date, level): growth of 1 from the first day with a positive NAV; days without NAV have no row."""
    first = F.min(F.when(F.col("nav_eur") > 0, F.col("as_of_date"))).over(Window.partitionBy("account_id"))
    rows = nav.join(daily_twr(nav, timing), ["account_id", "as_of_date"], "left").withColumn("first_", first).filter("as_of_date >= first_ and nav_eur is not null")
    return rows.withColumn("level", F.product(1 + F.coalesce("twr", F.lit(0.0))).over(up_to())).select("account_id", "as_of_date", "level")


def drawdown_series(index: DataFrame) -> DataFrame:
    """index with peak, peak_date (the last day of equals) and drawdown."""
    rows = index.withColumn("peak", F.max("level").over(up_to()))
    return rows.withColumn("peak_date", F.last(F.when(F.col("level") >= F.col("peak"), F.col("as_of_date")), ignorenulls=True).over(up_to())).withColumn("drawdown", F.col("level") / F.col("peak") - 1)


def worst_drawdown(index: DataFrame) -> DataFrame:
    """One row an account: the deepest drawdown (the first of equals), its peak, trough and recovery."""
    series = drawdown_series(index)
    worst = series.groupBy("account_id").agg(F.min_by(F.struct("as_of_date", "peak", "peak_date", "drawdown"), F.struct("drawdown", "as_of_date")).alias("w"), F.max("as_of_date").alias("last_day"), F.count("*").alias("n"))
    worst = worst.filter("n >= 2").select("account_id", "last_day", F.col("w.as_of_date").alias("trough_date"), F.col("w.peak").alias("peak"), F.col("w.peak_date").alias("peak_date"), F.col("w.drawdown").alias("drawdown"))
    later = index.join(worst, "account_id").filter("as_of_date > trough_date and level >= peak").groupBy("account_id").agg(F.min("as_of_date").alias("recovery_date"))
    out = worst.join(later, "account_id", "left")
    flat = F.col("drawdown") == 0
    recovery = F.when(flat, F.col("peak_date")).otherwise(F.col("recovery_date"))
    return out.select(
        "account_id", "peak_date", F.when(flat, F.col("peak_date")).otherwise(F.col("trough_date")).alias("trough_date"), recovery.alias("recovery_date"), "drawdown",
        F.when(flat, 0).otherwise(F.datediff(F.coalesce("recovery_date", "last_day"), "peak_date")).alias("time_underwater_days"), F.when(flat, 0).otherwise(F.datediff("recovery_date", "trough_date")).alias("recovery_days"),
    )


def metric(status: Column, value: Column, observations: Column) -> Column:
    return F.struct(status.alias("status"), F.when(status == "ok", value).alias("value"), observations.alias("observations"))


def risk_metrics(twr: DataFrame, risk_free: float = 0.0) -> DataFrame:
    """account_id, n and the metrics cumulative, annualised, volatility, downside, sharpe, sortino as value columns.

    Too few observations, a zero spread or a non-positive growth give null: the value can't be known.
    """
    r = F.col("twr")
    spread = F.when(F.count(r) >= 2, F.stddev_samp(r) * F.sqrt(F.lit(float(ANNUAL))))
    down = F.when(F.count(F.when(r < 0, 1)) >= 2, F.stddev_samp(F.when(r < 0, r)) * F.sqrt(F.lit(float(ANNUAL))))
    g = twr.groupBy("account_id").agg(F.count(r).alias("n"), F.product(1 + r).alias("growth"), F.avg(r).alias("mean"), spread.alias("volatility"), down.alias("downside_volatility"))
    excess = F.col("mean") * ANNUAL - risk_free
    return g.select(
        "account_id", "n", (F.col("growth") - 1).alias("cumulative"), F.when((F.col("n") >= 2) & (F.col("growth") > 0), F.pow("growth", ANNUAL / F.col("n")) - 1).alias("annualised"),
        "volatility", "downside_volatility", F.try_divide(excess, F.col("volatility")).alias("sharpe"), F.try_divide(excess, F.col("downside_volatility")).alias("sortino"),
    )


def horizon_returns(twr: DataFrame, days: int) -> DataFrame:
    """Overlapping products of `days` rows, only full ones."""
    w = by_day().rowsBetween(1 - days, 0)
    return twr.withColumn("n_", F.count("twr").over(w)).withColumn("ret", F.product(1 + F.col("twr")).over(w) - 1).filter(F.col("n_") == days).select("account_id", "as_of_date", "ret")


def var_cvar(twr: DataFrame, least: int = 20) -> DataFrame:
    """(account_id, confidence, horizon, n, var, cvar, tail, flat_share): historical simulation, linear quantiles."""
    out = None
    for days in (1, 10):
        rows = horizon_returns(twr, days)
        q = rows.groupBy("account_id").agg(F.count("*").alias("n"), F.avg((F.col("ret") == 0).cast("double")).alias("flat_share"), *[F.percentile("ret", F.lit(1 - c / 100)).alias(f"q{c}") for c in (95, 99)])
        levels = q.filter(F.col("n") >= max(least, days)).select("account_id", "n", "flat_share", F.explode(F.array(*[F.struct(F.lit(c).alias("confidence"), F.col(f"q{c}").alias("var")) for c in (95, 99)])).alias("l")).select("account_id", "n", "flat_share", "l.*")
        tail = rows.join(levels, "account_id").filter("ret <= var").groupBy("account_id", "n", "flat_share", "confidence", "var").agg(F.avg("ret").alias("cvar"), F.count("*").alias("tail")).withColumn("horizon", F.lit(days))
        out = tail if out is None else out.unionByName(tail)
    return out


def benchmark_stats(joined: DataFrame, keys: list[str]) -> DataFrame:
    """Beta, alpha, r2, correlation, tracking error and information ratio of (rp, rb) rows by keys.

    A benchmark that doesn't move gives nulls; a constant portfolio has r2 0 and no correlation.
    """
    rp, rb = F.col("rp"), F.col("rb")
    n = F.count("*")
    g = joined.groupBy(*keys).agg(
        n.alias("n"), F.avg(rp).alias("mp"), F.avg(rb).alias("mb"), F.var_samp(rp).alias("vp"), F.var_samp(rb).alias("vb"), F.covar_samp(rp, rb).alias("cov"), F.stddev_samp(rp - rb).alias("te_day"), F.avg(rp - rb).alias("active"),
    )
    ok = (F.col("n") >= 2) & (F.col("vb") > 0)
    beta = F.when(ok, F.try_divide(F.col("cov"), F.col("vb")))
    te = F.when(ok, F.col("te_day") * F.sqrt(F.lit(float(ANNUAL))))
    square = F.try_divide(F.col("cov") * F.col("cov"), F.col("vb") * F.col("vp"))
    return g.select(
        *keys, "n", beta.alias("beta"), ((F.col("mp") - beta * F.col("mb")) * ANNUAL).alias("alpha"), F.when(ok, F.coalesce(square, F.lit(0.0))).alias("r2"),
        F.when(ok & (F.col("vp") > 0), F.try_divide(F.col("cov"), F.sqrt(F.col("vb") * F.col("vp")))).alias("correlation"), te.alias("tracking_error"), F.try_divide(F.col("active") * ANNUAL, te).alias("information_ratio"),
    )


def rolling_volatility(twr: DataFrame, days: int) -> DataFrame:
    w = by_day().rowsBetween(1 - days, 0)
    return twr.withColumn("n_", F.count("twr").over(w)).withColumn("volatility", F.stddev_samp("twr").over(w) * F.sqrt(F.lit(float(ANNUAL)))).filter(F.col("n_") == days).select("account_id", "as_of_date", "volatility")


def rolling_beta(joined: DataFrame, days: int) -> DataFrame:
    w = by_day().rowsBetween(1 - days, 0)
    rows = joined.withColumn("n_", F.count("rp").over(w)).withColumn("v_", F.var_samp("rb").over(w)).withColumn("c_", F.covar_samp("rp", "rb").over(w))
    return rows.filter((F.col("n_") == days) & (F.col("v_") > 0)).select("account_id", "as_of_date", F.try_divide("c_", "v_").alias("beta"))


def rolling_both(twr: DataFrame, short: int = 30, long: int = 90) -> DataFrame:
    """Short and long rolling volatility side by side, whichever exist."""
    a = rolling_volatility(twr, short).withColumnRenamed("volatility", "short_volatility")
    b = rolling_volatility(twr, long).withColumnRenamed("volatility", "long_volatility")
    return a.join(b, ["account_id", "as_of_date"], "full_outer")
