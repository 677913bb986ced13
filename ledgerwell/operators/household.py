"""Spending buckets, budgets, payment rhythm and planning arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerwell.functions.money import js_round

#: A median gap in days (from, to) and the payments a year that it means.
CADENCES = ((25, 40, 12), (80, 105, 4), (160, 200, 2), (330, 400, 1))
RHYTHM_WINDOW = 8


def buckets(spending: DataFrame, key: str, unit: str) -> DataFrame:
    """(key, bucket, spent, n) for each day, Monday week or month from a key's first to its last, empty ones with 0."""
    at = F.trunc("day", unit) if unit in ("week", "month") else F.col("day")
    step = {"day": "interval 1 day", "week": "interval 7 days", "month": "interval 1 month"}[unit]
    sums = spending.groupBy(key, at.alias("bucket")).agg(F.sum("spent").alias("spent"), F.count("*").alias("n"))
    spine = sums.groupBy(key).agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi")).select(key, F.explode(F.sequence("lo", "hi", F.expr(step))).alias("bucket")).withColumn("bucket", F.col("bucket").cast("date"))
    return spine.join(sums, [key, "bucket"], "left").select(key, "bucket", F.coalesce("spent", F.lit(0)).alias("spent"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def budget_lines(spending: DataFrame, limits: DataFrame, today: str) -> DataFrame:
    """Each category's spending in the month of `today` against its limit, and at this pace by the month's end."""
    now = F.lit(today).cast("date")
    month = spending.groupBy("category").agg(F.sum(F.when(F.trunc("day", "month") == F.trunc(now, "month"), F.col("spent")).otherwise(0)).cast("double").alias("s"))
    rows = month.join(limits, "category", "full_outer").withColumn("spent", js_round(F.coalesce("s", F.lit(0.0))))
    pace = F.col("spent") / F.dayofmonth(now) * F.dayofmonth(F.last_day(now))
    return rows.select("category", "monthly_limit", "spent", js_round(pace).alias("projected"))


def payment_rhythm(payments: DataFrame, keys: list[str], day: str) -> DataFrame:
    """(keys, median_gap, per_year) from the gaps between the last RHYTHM_WINDOW distinct days; null if irregular."""
    days = payments.select(*keys, day).distinct()
    gaps = days.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(day)))).withColumn("gap", F.datediff(day, F.lag(day).over(Window.partitionBy(*keys).orderBy(day))))
    found = gaps.groupBy(*keys).agg(F.median(F.when(F.col("rn") < RHYTHM_WINDOW, F.col("gap"))).alias("median_gap"))
    per_year = F.lit(None).cast("int")
    for low, high, n in CADENCES:
        per_year = F.when(F.col("median_gap").between(low, high), n).otherwise(per_year)
    return found.withColumn("per_year", per_year)


def plan_allocation(positions: DataFrame, targets: DataFrame, deposit: float) -> DataFrame:
    """Each planned position's drift, its part of the deposit (by shortfall), its weight after and the full trade.

    Targets are rescaled to those an account holds; a position without a positive target is outside the plan.
    """
    whole = Window.partitionBy("account_id")
    p = positions.join(targets.filter("target > 0"), "ticker").withColumn("share", F.col("target") / F.sum("target").over(whole)).withColumn("planned", F.sum(F.greatest("value", F.lit(0.0))).over(whole))
    amount = F.lit(max(float(deposit), 0.0))
    after = F.col("planned") + amount
    p = p.withColumn("shortfall", F.greatest(F.col("share") * after - F.col("value"), F.lit(0.0))).withColumn("short", F.sum("shortfall").over(whole))
    p = p.withColumn("buy", F.when(F.col("short") > 0, amount * F.col("shortfall") / F.col("short")).otherwise(0.0))
    weight = F.when(F.col("planned") > 0, F.col("value") / F.col("planned")).otherwise(0.0)
    return p.select("account_id", "ticker", "value", weight.alias("weight"), F.col("share").alias("target"), (weight - F.col("share")).alias("drift"), "buy", F.when(after > 0, (F.col("value") + F.col("buy")) / after).otherwise(0.0).alias("weight_after"), (F.col("share") * F.col("planned") - F.col("value")).alias("full_trade"))


def _monthly(yearly: Column) -> Column:
    return F.pow(1 + yearly, F.lit(1 / 12.0)) - 1


def future_value(value: Column, monthly: Column, yearly: Column, months: Column) -> Column:
    """Value after so many months of compounding with a payment at each month's end."""
    rate = _monthly(yearly)
    growth = F.pow(1 + rate, months)
    return F.when(months <= 0, value).when(F.abs(rate) < 1e-12, value + monthly * months).otherwise(value * growth + monthly * F.try_divide(growth - 1, rate))


def required_monthly(value: Column, target: Column, yearly: Column, months: Column) -> Column:
    """The monthly payment that reaches the target; 0 if growth alone does, null without months left."""
    rate = _monthly(yearly)
    growth = F.pow(1 + rate, months)
    gap = target - value * growth
    return F.when(months > 0, F.when(gap <= 0, 0.0).when(F.abs(rate) < 1e-12, F.try_divide(gap, months)).otherwise(F.try_divide(gap * rate, growth - 1)))


def card_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, spent, refunded, cashback, cashback_rate, n, currency) of card rows (amount: negative is spent, label, currency).

    Money that comes back by card is refunded; the rate is of what was spent and not refunded; currency is the most
    frequent one, the first of equals.
    """
    card, back = F.col("label") == "card", F.col("label") == "cashback"
    total = lambda cond, v: F.coalesce(F.sum(F.when(cond, v)), F.lit(0))
    counts = rows.groupBy(*by, "currency").agg(F.count("*").alias("n_"))
    mode = counts.groupBy(*by).agg(F.min(F.struct((-F.col("n_")).alias("n_"), "currency")).alias("m_"))
    g = rows.groupBy(*by).agg(
        total(card & (F.col("amount") < 0), -F.col("amount")).alias("spent"), total(card & (F.col("amount") > 0), F.col("amount")).alias("refunded"),
        total(back, F.col("amount")).alias("cashback"), F.count(F.when(card, 1)).alias("n"),
    )
    net = F.col("spent") - F.col("refunded")
    joined = g.join(mode, by)
    return joined.select(*by, "spent", "refunded", "cashback", F.when(net > 0, F.col("cashback").cast("double") / net.cast("double")).alias("cashback_rate"), "n", F.col("m_.currency").alias("currency"))


def merchant_profile(spending: DataFrame) -> DataFrame:
    """(merchant, spent, n, average, largest, largest_id, first_ts, last_ts, busiest_hour) of each merchant's charges."""
    hours = spending.groupBy("merchant", F.hour("ts").alias("h")).agg(F.sum("spent").alias("s")).groupBy("merchant").agg(F.min(F.struct((-F.col("s")).alias("s"), "h")).alias("b"))
    largest = F.min(F.struct((-F.col("spent")).alias("s"), "ts", "event_id"))
    g = spending.groupBy("merchant").agg(F.sum("spent").alias("spent"), F.count("*").alias("n"), largest.alias("l"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    money = F.col("spent").cast("double")
    return g.join(hours, "merchant").select("merchant", js_round(money).alias("spent"), "n", js_round(money / F.col("n")).alias("average"), (-F.col("l.s")).cast("double").alias("largest"), F.col("l.event_id").alias("largest_id"), "first_ts", "last_ts", F.col("b.h").alias("busiest_hour"))


#: Fixed value: the first day of a month on which a budget's pace is judged.
PACE_DAY = 5


def budget_notices(lines: DataFrame, today: str) -> DataFrame:
    """(category, kind, dedupe_key) of budgets that are exceeded, or will be at this pace; from budget_lines."""
    now = F.lit(today).cast("date")
    pace = F.col("spent") / F.dayofmonth(now) * F.dayofmonth(F.last_day(now))
    kind = F.when(F.col("spent") > F.col("monthly_limit"), "over").when((F.dayofmonth(now) >= PACE_DAY) & (pace > F.col("monthly_limit")), "pace")
    rows = lines.filter("monthly_limit > 0").withColumn("kind", kind).filter("kind is not null")
    return rows.select("category", "kind", F.concat_ws(":", F.lit("budget"), F.date_format(now, "yyyy-MM"), "category", "kind").alias("dedupe_key"))


def cash_flow_months(nav: DataFrame) -> DataFrame:
    """(account_id, month, deposited, spent_by_card, to_bank, kept) by calendar month of the day itself."""
    out, card = -F.col("withdrawal_eur"), -F.col("card_spending_eur")
    total = lambda x: js_round(F.sum(x).cast("double"))
    return nav.groupBy("account_id", F.date_format("as_of_date", "yyyy-MM").alias("month")).agg(
        total(F.col("deposit_eur")).alias("deposited"), total(card).alias("spent_by_card"), total(F.greatest(out - card, F.lit(0))).alias("to_bank"), total(F.col("deposit_eur") - out).alias("kept"),
    )


def net_share(payments: DataFrame, keys: list[str], day: str, received: str, gross: str) -> DataFrame:
    """(keys, net_share): the median of received / gross over the last RHYTHM_WINDOW payments, within 0.5 and 1."""
    last = payments.withColumn("rn_", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(day), F.desc(received), F.desc(gross)))).filter(F.col("rn_") <= RHYTHM_WINDOW)
    share = F.median(F.when(F.col(gross) > 0, F.col(received).cast("double") / F.col(gross).cast("double")))
    return last.groupBy(*keys).agg(share.alias("s")).filter("s is not null").select(*keys, F.least(F.greatest("s", F.lit(0.5)), F.lit(1.0)).alias("net_share"))


def project_payments(rhythm: DataFrame, last: DataFrame, keys: list[str], today: str, months_ahead: int = 12) -> DataFrame:
    """(keys, day, amount): payments stepped forward from the last one by 12 / per_year months, up to so many months ahead.

    Those already past are left out. The n-th is n steps after the last payment, so month ends don't drift.
    """
    now = F.lit(today).cast("date")
    step = (F.lit(12) / F.col("per_year")).cast("int")
    rows = rhythm.filter("per_year is not null").join(last, keys)
    # a rhythm that stopped long ago still steps from its last payment: the number of steps follows from the dates
    n = F.ceil(F.months_between(F.add_months(now, months_ahead), F.col("last_day")) / step).cast("int")
    days = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.add_months("last_day", k * step))
    return rows.select(*keys, F.explode(days).alias("day"), "amount").filter((F.col("day") >= now) & (F.col("day") < F.add_months(now, months_ahead)))


def round_to_cents(rows: DataFrame, keys: list[str], amount: str, order: str) -> DataFrame:
    """rows with cents: amounts in whole cents that add up to the rounded total of each key (largest remainders first)."""
    whole = Window.partitionBy(*keys)
    cents, floored = F.col(amount) * 100, F.floor(F.col(amount) * 100)
    left = F.floor(F.sum(amount).over(whole) * 100 + 0.5) - F.sum(floored).over(whole)
    rank = F.row_number().over(whole.orderBy(F.desc(F.col("c_") - F.col("f_")), order))
    out = rows.withColumn("c_", cents).withColumn("f_", floored).withColumn("left_", left).withColumn("rank_", rank)
    return out.withColumn("cents", (F.col("f_") + F.when(F.col("rank_") <= F.col("left_"), 1).otherwise(0)).cast("long")).drop("c_", "f_", "left_", "rank_")


def goal_status(kind: Column, value: Column, target: Column, months: Column, monthly: Column, yearly: Column, income: Column) -> Column:
    """struct(current, projected, status, required_monthly) of a value or an income goal; income at today's yield."""
    end = future_value(value, monthly, yearly, F.greatest(months, F.lit(0)))
    rate = F.when(value > 0, income / value).otherwise(0.0)
    is_income = kind == "income"
    current, projected = F.when(is_income, income / 12).otherwise(value), F.when(is_income, end * rate / 12).otherwise(end)
    needed = F.when(is_income, F.try_divide(target * 12, F.when(rate > 0, rate))).otherwise(target)
    status = F.when(current >= target, "reached").when(months <= 0, "missed").when(projected >= target, "on-track").otherwise("behind")
    return F.struct(current.alias("current"), projected.alias("projected"), status.alias("status"), F.when(status == "behind", required_monthly(value, needed, yearly, months)).alias("required_monthly"))
