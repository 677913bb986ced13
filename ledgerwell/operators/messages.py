"""What the weekly and the daily message say: movers with their stories, card spending, budgets, facts of a day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How many movers, stories of each and merchants a weekly message names; merchants and categories without a name.
MOVERS, STORIES, MERCHANTS = 6, 3, 5
NO_MERCHANT, NO_CATEGORY = "Unknown", "UNCATEGORISED"


def top_movers(results: DataFrame, most: int = MOVERS) -> DataFrame:
    """(account_id, rank, ticker, result) of results(account_id, ticker, result): the largest in either direction, then by ticker."""
    by = Window.partitionBy("account_id").orderBy(F.desc(F.abs("result")), "ticker")
    return results.filter("result is not null").withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= most).select("account_id", "rank", "ticker", "result")


def stories(news: DataFrame, now: Column, most: int = STORIES) -> DataFrame:
    """(ticker, rank, headline, source, published) of news(ticker, ts, headline, source, place) of the last seven days, in `place` order."""
    recent = news.filter(F.col("ticker").isNotNull() & (F.col("ts") >= now - F.expr("interval 7 days")))
    ranked = recent.withColumn("rank", F.row_number().over(Window.partitionBy("ticker").orderBy("place"))).filter(F.col("rank") <= most)
    return ranked.select("ticker", "rank", "headline", "source", F.to_date("ts").alias("published"))


def _card(action: Column) -> Column:
    """Whether an export row is a card payment (not a cashback)."""
    a = F.lower(F.trim(action))
    return F.startswith(a, F.lit("card ")) & ~F.contains(a, F.lit("cashback"))


def card_spending(cards: DataFrame, now: Column) -> DataFrame:
    """(account_id, last_7_days, previous_7_days) of cards(account_id, ts, action, total, merchant, category); money spent is positive."""
    age = lambda days: now - F.expr(f"interval {days} days")
    spent = lambda a, b: F.coalesce(F.sum(F.when((F.col("ts") >= a) & (F.col("ts") < b), -F.col("total"))), F.lit(0))
    return cards.filter(_card(F.col("action")) & F.col("total").isNotNull()).groupBy("account_id").agg(spent(age(7), now).alias("last_7_days"), spent(age(14), age(7)).alias("previous_7_days"))


def top_merchants(cards: DataFrame, now: Column, most: int = MERCHANTS) -> DataFrame:
    """(account_id, rank, merchant, spent) of the last seven days, largest first, then by name."""
    week = cards.filter(_card(F.col("action")) & F.col("total").isNotNull() & (F.col("ts") >= now - F.expr("interval 7 days")) & (F.col("ts") < now))
    sums = week.groupBy("account_id", F.coalesce(F.nullif("merchant", F.lit("")), F.lit(NO_MERCHANT)).alias("merchant")).agg(F.sum(-F.col("total")).alias("spent"))
    return sums.withColumn("rank", F.row_number().over(Window.partitionBy("account_id").orderBy(F.desc("spent"), "merchant"))).filter(F.col("rank") <= most).select("account_id", "rank", "merchant", "spent")


def budgets_this_month(cards: DataFrame, budgets: DataFrame, now: Column) -> DataFrame:
    """(account_id, category, monthly_limit, spent) of each budget in the month of now; nothing spent is 0."""
    month = cards.filter(_card(F.col("action")) & F.col("total").isNotNull() & (F.col("ts") >= F.date_trunc("month", now)))
    sums = month.groupBy("account_id", F.coalesce(F.nullif("category", F.lit("")), F.lit(NO_CATEGORY)).alias("category")).agg(F.sum(-F.col("total")).alias("spent"))
    return budgets.join(sums, ["account_id", "category"], "left").select("account_id", "category", "monthly_limit", F.coalesce("spent", F.lit(0)).alias("spent"))


def weekly_payload(results: DataFrame, news: DataFrame, cards: DataFrame, budgets: DataFrame, alerts: DataFrame, now: Column) -> DataFrame:
    """(account_id, part, rank, item, amount, detail): all that a weekly message may say, one row a fact.

    Parts are mover, story (detail: the mover's ticker, source and day), spending, merchant, budget (detail: the limit)
    and alert; alerts(account_id, title, created_at) count if they fired in the last seven days.
    """
    money = "decimal(38,10)"
    none = F.lit(None).cast("string")
    row = lambda df, part, rank, item, amount, detail: df.select("account_id", F.lit(part).alias("part"), rank.cast("int").alias("rank"), item.cast("string").alias("item"), amount.cast(money).alias("amount"), detail.cast("string").alias("detail"))
    movers = top_movers(results)
    told = movers.select("account_id", "ticker").join(stories(news, now), "ticker")
    spending = card_spending(cards, now)
    fired = alerts.filter(F.col("created_at") >= now - F.expr("interval 7 days")).withColumn("rank", F.row_number().over(Window.partitionBy("account_id").orderBy("created_at", "title")))
    out = row(movers, "mover", F.col("rank"), F.col("ticker"), F.col("result"), none)
    out = out.unionByName(row(told, "story", F.col("rank"), F.col("headline"), F.lit(None), F.concat_ws(" ", "ticker", "source", F.col("published").cast("string"))))
    for name in ("last_7_days", "previous_7_days"):
        out = out.unionByName(row(spending, "spending", F.lit(1), F.lit(name), F.col(name), none))
    out = out.unionByName(row(top_merchants(cards, now), "merchant", F.col("rank"), F.col("merchant"), F.col("spent"), none))
    out = out.unionByName(row(budgets_this_month(cards, budgets, now), "budget", F.lit(1), F.col("category"), F.col("spent"), F.col("monthly_limit")))
    return out.unionByName(row(fired, "alert", F.col("rank"), F.col("title"), F.lit(None), F.col("created_at")))


def daily_facts(results: DataFrame, cards: DataFrame, moves: DataFrame, news: DataFrame, start: Column) -> DataFrame:
    """(account_id, best, best_result, worst, worst_result, card_spent, card_payments, stories) of the day from start on.

    results(account_id, ticker, result) are the day's; cards(account_id, row_id, ts, action, total) the export;
    moves(account_id, reference, ts, transaction_type, amount) the ledger, whose withdrawals without a card row of the day
    count too; news(account_id, ts). An account with none of these has no row; a missing fact is null, a missing sum 0.
    """
    known = results.filter("result is not null")
    # of equal results the first ticker counts: the best one is the least by the negated result
    ends = known.groupBy("account_id").agg(F.min(F.struct((-F.col("result")).alias("r"), "ticker")).alias("b"), F.min(F.struct(F.col("result").alias("r"), "ticker")).alias("w"))
    ends = ends.select("account_id", F.col("b.ticker").alias("best"), (-F.col("b.r")).alias("best_result"), F.col("w.ticker").alias("worst"), F.col("w.r").alias("worst_result"))
    today = cards.filter((F.col("ts") >= start) & F.startswith(F.lower("action"), F.lit("card ")) & F.col("total").isNotNull())
    out = moves.filter((F.col("ts") >= start) & F.upper(F.coalesce("transaction_type", F.lit(""))).isin("WITHDRAW", "WITHDRAWAL") & F.col("amount").isNotNull())
    unlabelled = out.join(today.select("account_id", F.col("row_id").alias("reference")).distinct(), ["account_id", "reference"], "left_anti")
    paid = today.select("account_id", F.col("total").alias("x")).unionByName(unlabelled.select("account_id", F.col("amount").alias("x"))).groupBy("account_id").agg(F.sum(-F.col("x")).alias("card_spent"), F.count("*").alias("card_payments"))
    told = news.filter(F.col("ts") >= start).groupBy("account_id").agg(F.count("*").alias("stories"))
    rows = ends.join(paid, "account_id", "full_outer").join(told, "account_id", "full_outer")
    return rows.select("account_id", "best", "best_result", "worst", "worst_result", F.coalesce("card_spent", F.lit(0)).alias("card_spent"), F.coalesce("card_payments", F.lit(0)).cast("long").alias("card_payments"), F.coalesce("stories", F.lit(0)).cast("long").alias("stories"))
