"""Periods: what moved and what was made, per named period, calendar month and holding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerwell.functions.money import MONEY, ratio

#: The named periods in their order.
PERIODS = ("1D", "1W", "1M", "3M", "YTD", "1Y", "ALL")

_PARTS = ("deposit_eur", "withdrawal_eur", "dividend_eur", "interest_eur", "fee_eur", "card_spending_eur", "cashback_eur")


def money_in_out(nav: DataFrame) -> DataFrame:
    """nav with gross money in and out: the recorded columns if both are there, else the net flow by its sign."""
    both = F.col("deposit_eur").isNotNull() & F.col("withdrawal_eur").isNotNull()
    flow, zero = F.col("external_flow_eur"), F.lit(0).cast(MONEY)
    return nav.withColumn("deposit_", F.when(both, F.col("deposit_eur")).otherwise(F.greatest(flow, zero))).withColumn("withdrawal_eur", F.when(both, F.col("withdrawal_eur")).otherwise(F.least(flow, zero))).drop("deposit_eur").withColumnRenamed("deposit_", "deposit_eur")


def nominal_start(period: Column, end: Column) -> Column:
    """The date whose closing value a period starts from; null means inception."""
    return (
        F.when(period == "1W", F.date_sub(end, 7)).when(period == "1M", F.add_months(end, -1)).when(period == "3M", F.add_months(end, -3))
        .when(period == "YTD", F.date_sub(F.trunc(end, "year"), 1)).when(period == "1Y", F.add_months(end, -12))
    )


def period_bounds(nav: DataFrame) -> DataFrame:
    """(account_id, period, start_date, end_date): start null is inception. 1D spans the last two valued weekdays."""
    valued = nav.filter("nav_eur is not null")
    ends = valued.groupBy("account_id").agg(F.max("as_of_date").alias("end_date"))
    starts = valued.select("account_id", F.col("as_of_date").alias("day")).join(ends, "account_id").groupBy("account_id", "end_date").agg(
        *[F.max(F.when(F.col("day") <= nominal_start(F.lit(p), F.col("end_date")), F.col("day"))).alias(p) for p in PERIODS[1:]],
    )
    named = starts.select("account_id", "end_date", F.explode(F.array(*[F.struct(F.lit(p).alias("period"), F.col(p).alias("start_date")) for p in PERIODS[1:]])).alias("p"))
    weekdays = valued.filter(F.weekday("as_of_date") < 5).withColumn("rn", F.row_number().over(Window.partitionBy("account_id").orderBy(F.desc("as_of_date")))).filter("rn <= 2")
    day = weekdays.groupBy("account_id").agg(F.min("as_of_date").alias("start_date"), F.max("as_of_date").alias("end_date"), F.count("*").alias("n")).filter("n = 2")
    rest = named.select("account_id", "p.period", "p.start_date", "end_date")
    return rest.unionByName(day.select("account_id", F.lit("1D").alias("period"), "start_date", "end_date"))


def month_bounds(nav: DataFrame) -> DataFrame:
    """(account_id, period, start_date, end_date) of each calendar month from the first row to the last valued day.

    end_date is null for a month without a valued day, start_date for the first closing value (inception).
    """
    valued = nav.filter("nav_eur is not null").select("account_id", F.col("as_of_date").alias("day"))
    span = nav.groupBy("account_id").agg(F.min("as_of_date").alias("first_day"), F.max(F.when(F.col("nav_eur").isNotNull(), F.col("as_of_date"))).alias("last_day")).filter("last_day is not null")
    months = span.select("account_id", F.explode(F.sequence(F.trunc("first_day", "month"), F.trunc("last_day", "month"), F.expr("interval 1 month"))).alias("month"))
    closes = valued.groupBy("account_id", F.trunc("day", "month").cast("date").alias("month")).agg(F.max("day").alias("end_date"))
    rows = months.withColumn("month", F.col("month").cast("date")).join(closes, ["account_id", "month"], "left")
    before = F.max("end_date").over(Window.partitionBy("account_id").orderBy("month").rowsBetween(Window.unboundedPreceding, -1))
    return rows.select("account_id", F.date_format("month", "yyyy-MM").alias("period"), before.alias("start_date"), "end_date")


def summarise(nav: DataFrame, twr: DataFrame, bounds: DataFrame, disjoint: bool = False) -> DataFrame:
    """One row a bound: everything after start_date up to end_date. Value change = net deposits + result, and
    result = market + dividends + interest + cashback + fees.

    A few bounds that overlap take one pass over an account's days each. Of `disjoint` ones that follow each other, such
    as months, each day belongs to the first that ends on it or later, so days are joined once.
    """
    rows = money_in_out(nav).join(twr, ["account_id", "as_of_date"], "left")
    if disjoint:
        ends = bounds.filter("end_date is not null").select("account_id", F.col("end_date").alias("as_of_date"), F.col("end_date").alias("ends_"))
        later = Window.partitionBy("account_id").orderBy("as_of_date").rowsBetween(0, Window.unboundedFollowing)
        rows = rows.join(ends, ["account_id", "as_of_date"], "left").withColumn("end_date", F.first("ends_", ignorenulls=True).over(later)).drop("ends_").filter("end_date is not null")
        window = bounds.join(rows, ["account_id", "end_date"])
    else:
        window = bounds.join(rows, "account_id").filter("as_of_date <= end_date and (start_date is null or as_of_date > start_date)")
    money = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0))).cast(MONEY).alias(c)
    sums = window.groupBy("account_id", "period", "start_date", "end_date").agg(*[money(c) for c in _PARTS], F.product(1 + F.col("twr")).alias("growth"), F.count(F.when(F.col("nav_eur").isNull(), 1)).alias("unvalued_days"))
    at = nav.select("account_id", F.col("as_of_date").alias("at_day"), F.col("nav_eur").alias("at_value"))
    sums = sums.join(at.select("account_id", F.col("at_day").alias("end_date"), F.col("at_value").alias("end_value_eur")), ["account_id", "end_date"], "left")
    sums = sums.join(at.select("account_id", F.col("at_day").alias("start_date"), F.col("at_value").alias("start_at")), ["account_id", "start_date"], "left")
    s = sums.withColumn("start_value_eur", F.when(F.col("start_date").isNull(), F.lit(0).cast(MONEY)).otherwise(F.col("start_at"))).withColumn("net_deposits_eur", (F.col("deposit_eur") + F.col("withdrawal_eur")).cast(MONEY))
    s = s.withColumn("value_change_eur", (F.col("end_value_eur") - F.col("start_value_eur")).cast(MONEY)).withColumn("result_eur", (F.col("value_change_eur") - F.col("net_deposits_eur")).cast(MONEY))
    s = s.withColumn("market_eur", (F.col("result_eur") - F.col("dividend_eur") - F.col("interest_eur") - F.col("cashback_eur") - F.col("fee_eur")).cast(MONEY))
    return s.select("account_id", "period", "start_date", "end_date", "start_value_eur", "end_value_eur", "value_change_eur", *_PARTS, "net_deposits_eur", "result_eur", "market_eur", (F.col("growth") - 1).alias("twr"), "unvalued_days", F.when(F.col("value_change_eur").isNotNull(), "ok").otherwise("insufficient_data").alias("status"))


def net_deposits_to_date(nav: DataFrame) -> DataFrame:
    total = F.sum("external_flow_eur").over(Window.partitionBy("account_id").orderBy("as_of_date").rowsBetween(Window.unboundedPreceding, 0))
    return nav.select("account_id", "as_of_date", total.cast(MONEY).alias("net_deposits_eur"))


def holding_movements(holdings: DataFrame, flows: DataFrame, bounds: DataFrame) -> DataFrame:
    """One row a bound and ticker that was held at either end or traded inside: result = end - start - bought + sold + dividends.

    A holding without a value at one end has no result; the return needs a positive start value plus purchases.
    """
    b = bounds.filter("end_date is not null")
    held = holdings.filter("quantity <> 0")
    price = (F.col("close_price").cast("double") * F.col("fx_rate_to_eur").cast("double")).alias("price")
    end = b.join(held.select("account_id", F.col("as_of_date").alias("end_date"), "ticker", F.struct(F.col("market_value_eur").alias("value"), "quantity", price).alias("e")), ["account_id", "end_date"]).select("account_id", "period", "ticker", "e")
    start = b.join(held.select("account_id", F.col("as_of_date").alias("start_date"), "ticker", F.struct(F.col("market_value_eur").alias("value"), "quantity", price).alias("s")), ["account_id", "start_date"]).select("account_id", "period", "ticker", "s")
    inside = b.join(flows, "account_id").filter("as_of_date <= end_date and (start_date is null or as_of_date > start_date)").groupBy("account_id", "period", "ticker").agg(*[F.sum(c).cast(MONEY).alias(c) for c in ("bought_eur", "sold_eur", "dividend_eur")])
    m = end.join(start, ["account_id", "period", "ticker"], "full_outer").join(inside, ["account_id", "period", "ticker"], "full_outer")
    zero = F.lit(0).cast(MONEY)
    m = m.withColumns({c: F.coalesce(c, zero) for c in ("bought_eur", "sold_eur", "dividend_eur")})
    m = m.withColumn("start_value_eur", F.when(F.col("s").isNull(), zero).otherwise(F.col("s.value"))).withColumn("end_value_eur", F.when(F.col("e").isNull(), zero).otherwise(F.col("e.value")))
    m = m.withColumn("result_eur", (F.col("end_value_eur") - F.col("start_value_eur") - F.col("bought_eur") + F.col("sold_eur") + F.col("dividend_eur")).cast(MONEY))
    capital = F.col("start_value_eur") + F.col("bought_eur")
    change = ratio(F.col("e.price"), F.when(F.col("s.price") != 0, F.col("s.price"))) - 1
    return m.select("account_id", "period", "ticker", "start_value_eur", "end_value_eur", "bought_eur", "sold_eur", "dividend_eur", "result_eur", F.when(capital > 0, ratio(F.col("result_eur"), capital)).alias("return_pct"), change.alias("price_change_pct"))


def unattributed(summaries: DataFrame, movements: DataFrame) -> DataFrame:
    """What the holdings' results leave of a period's result, where every holding has one."""
    sums = movements.groupBy("account_id", "period").agg(F.sum("result_eur").cast(MONEY).alias("explained"), F.bool_and(F.col("result_eur").isNotNull()).alias("all_priced"))
    return summaries.join(sums, ["account_id", "period"], "left").select("account_id", "period", F.when(F.coalesce("all_priced", F.lit(True)), F.col("result_eur") - F.coalesce("explained", F.lit(0))).cast(MONEY).alias("unattributed_eur"))
