"""What a portfolio consists of: weights, concentration, contributions, attribution, groups and histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerwell.functions.money import ratio
from ledgerwell.operators.asof import as_of

#: Sectors of a benchmark at most: they become part of the plan.
MOST_SECTORS = 500


def latest_weights(holdings: DataFrame) -> DataFrame:
    """Weights on the last day that an account has holdings (which can be before its last NAV)."""
    last = holdings.groupBy("account_id").agg(F.max("as_of_date").alias("as_of_date"))
    rows = holdings.join(last, ["account_id", "as_of_date"]).filter("market_value_eur is not null")
    total = F.sum("market_value_eur").over(Window.partitionBy("account_id"))
    return rows.withColumn("weight", ratio(F.col("market_value_eur"), F.when(total != 0, total))).select("account_id", "ticker", "as_of_date", "weight")


def average_weights(holdings: DataFrame) -> DataFrame:
    """Mean daily share over the days with a non-zero total; a holding that is absent counts as 0."""
    v = holdings.filter("market_value_eur is not null")
    total = F.sum("market_value_eur").over(Window.partitionBy("account_id", "as_of_date"))
    shares = v.withColumn("share", ratio(F.col("market_value_eur"), total)).filter("share is not null")
    days = shares.groupBy("account_id").agg(F.count_distinct("as_of_date").alias("days"))
    return shares.groupBy("account_id", "ticker").agg(F.sum("share").alias("s")).join(days, "account_id").select("account_id", "ticker", (F.col("s") / F.col("days")).alias("weight"))


def concentration(weights: DataFrame, top: int = 5) -> DataFrame:
    """Herfindahl index, its inverse and the weight of the largest `top`."""
    ranked = weights.withColumn("rn", F.row_number().over(Window.partitionBy("account_id").orderBy(F.desc("weight"), "ticker")))
    return ranked.groupBy("account_id").agg(F.sum(F.col("weight") * F.col("weight")).alias("hhi"), F.try_divide(F.lit(1.0), F.sum(F.col("weight") * F.col("weight"))).alias("effective_holdings"), F.sum(F.when(F.col("rn") <= top, F.col("weight"))).alias("top_weight"))


def price_returns(holdings: DataFrame) -> DataFrame:
    """(account_id, ticker, as_of_date, ret): unit price in EUR against the last valued row; gaps are bridged here."""
    unit = ratio(F.col("market_value_eur"), F.col("quantity"))
    rows = holdings.withColumn("unit", unit).filter("unit is not null")
    before = F.lag("unit").over(Window.partitionBy("account_id", "ticker").orderBy("as_of_date"))
    return rows.withColumn("ret", F.try_divide(F.col("unit"), before) - 1).filter("ret is not null").select("account_id", "ticker", "as_of_date", "ret")


def window_returns(holdings: DataFrame) -> DataFrame:
    """First to last valued unit price of each holding."""
    rows = holdings.withColumn("unit", ratio(F.col("market_value_eur"), F.col("quantity"))).filter("unit is not null")
    g = rows.groupBy("account_id", "ticker").agg(F.min_by("unit", "as_of_date").alias("first"), F.max_by("unit", "as_of_date").alias("last"), F.count("*").alias("n"))
    return g.filter("n >= 2 and first <> 0").select("account_id", "ticker", (F.col("last") / F.col("first") - 1).alias("ret"))


def contributions(weights: DataFrame, returns: DataFrame) -> DataFrame:
    """Weight times latest return; a missing return is a status, never 0."""
    latest = returns.groupBy("account_id", "ticker").agg(F.max_by("ret", "as_of_date").alias("ret"))
    out = weights.join(latest, ["account_id", "ticker"], "left")
    return out.select("account_id", "ticker", "weight", (F.col("weight") * F.col("ret")).alias("contribution"), F.when(F.col("ret").isNull(), "insufficient_data").otherwise("ok").alias("status"))


def brinson(portfolio: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Allocation, selection and interaction of each sector, from (account_id, sector, wp, rp) and (sector, wb, rb).

    A sector that only the benchmark has gets weight 0 and the benchmark's return; one it hasn't, benchmark weight and
    return 0.
    """
    sectors = benchmark.select("sector", "wb", "rb").limit(MOST_SECTORS + 1).collect()
    if len(sectors) > MOST_SECTORS:
        raise ValueError(f"a benchmark has at most {MOST_SECTORS} sectors")
    rows = F.array(*[F.struct(F.lit(x.sector).alias("sector"), F.lit(x.wb).alias("wb"), F.lit(x.rb).alias("rb")) for x in sectors])
    b = portfolio.select("account_id").distinct().select("account_id", F.explode(rows).alias("b")).select("account_id", "b.*")
    rb_total = F.lit(sum((x.wb or 0.0) * (x.rb or 0.0) for x in sectors))
    j = portfolio.join(b, ["account_id", "sector"], "full_outer")
    wp, wb, rb = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("wp", "wb", "rb"))
    rp = F.coalesce(F.col("rp"), F.col("rb"), F.lit(0.0))
    return j.select("account_id", "sector", ((wp - wb) * (rb - rb_total)).alias("allocation"), (wb * (rp - rb)).alias("selection"), ((wp - wb) * (rp - rb)).alias("interaction"))


def histogram(values: DataFrame, by: str, value: str, bins: int = 18) -> DataFrame:
    """(by, bin, n): equal widths from the least to the greatest value, which is in the last bin. Only bins with values."""
    edges = values.groupBy(by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0)
    return values.join(edges, by).select(by, at.cast("int").alias("bin")).groupBy(by, "bin").agg(F.count("*").alias("n"))


def donut(weights: DataFrame, top: int = 5) -> DataFrame:
    """The largest `top` holdings and one row for the others."""
    rn = F.row_number().over(Window.partitionBy("account_id").orderBy(F.desc("weight"), "ticker"))
    label = F.when(F.col("rn") <= top, F.col("ticker")).otherwise("Other")
    return weights.withColumn("rn", rn).groupBy("account_id", label.alias("slice")).agg(F.sum("weight").alias("weight"), F.count("*").alias("n"))


def counterfactual(flows: DataFrame, prices: DataFrame, spine: DataFrame, max_stale_days: int = 10) -> DataFrame:
    """(account_id, as_of_date, units, value, excluded): the same money in an index, bought at the flow day's price or the next.

    flows(account_id, as_of_date, eur), prices(price_date, close), spine(account_id, as_of_date). `excluded` counts the
    flows so far that no price was found for.
    """
    index = prices.select(F.lit("index").alias("key"), "price_date", "close")
    at_price = lambda df: as_of(df.withColumn("key", F.lit("index")), index, ["key"], "as_of_date", "price_date", ["close"], max_stale_days=max_stale_days, or_next=True)
    # prices by day are found once a day, not once a row
    days = at_price(spine.select("as_of_date").unionByName(flows.select("as_of_date")).distinct()).select("as_of_date", F.col("close").cast("double").alias("close"))
    bought = flows.join(days, "as_of_date").groupBy("account_id", "as_of_date").agg(F.sum(ratio(F.col("eur"), F.col("close"))).alias("units"), F.count(F.when(F.col("close").isNull(), 1)).alias("lost"))
    run = lambda c: F.sum(c).over(Window.partitionBy("account_id").orderBy("as_of_date").rowsBetween(Window.unboundedPreceding, 0))
    out = spine.join(days, "as_of_date").join(bought, ["account_id", "as_of_date"], "left").withColumn("held", run("units")).withColumn("excluded", F.coalesce(run("lost"), F.lit(0)))
    return out.filter("held is not null and close is not null").select("account_id", "as_of_date", F.col("held").alias("units"), (F.col("held") * F.col("close")).alias("value"), "excluded")
