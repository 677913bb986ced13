"""Company figures from reported facts, and what a portfolio holds once its funds are taken apart."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerwell.operators.filings import cusip

#: Days of a year's and a quarter's facts, how old a figure may be next to the newest, days of a price range.
YEAR_DAYS, QUARTER_DAYS = (350, 380), (80, 100)
STALE_FIGURE_DAYS, RANGE_DAYS = 550, 372
WARN_SHARE = 0.10


def _days(of: str = "") -> Column:
    return F.coalesce(F.datediff(f"{of}end", f"{of}start"), F.lit(0))


def nearest(targets: DataFrame, facts: DataFrame, keys: list[str], tolerance: int) -> DataFrame:
    """targets (keys, aim date, aim_days) with `near`, a fact that ends and lasts about so: the one filed last, then the earliest.

    Both the end and the length may be off by `tolerance` days; targets without such a fact are left out.
    """
    about = (F.abs(F.datediff("end", "aim")) <= tolerance) & (F.abs(F.datediff("end", "start") - F.col("aim_days")) <= tolerance)
    order = F.struct("filed", -F.unix_date("end"), -F.unix_date("start"))
    found = targets.join(facts.select(*keys, "start", "end", "val", "filed"), keys).filter(about)
    return found.groupBy(*targets.columns).agg(F.max_by(F.struct("start", "end", "val"), order).alias("near"))


def trailing_year(facts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ttm, ttm_end): the fiscal year, rolled forward by this year to date less last year's.

    Without a year to date that has its like a year before: the last four quarters if they lie within 290 days, else the
    last fiscal year. facts has (keys, start, end, val, filed), one row a span; rows without a start take no part.
    """
    spans = facts.filter("start is not null").withColumn("n_days", _days())
    year = F.col("n_days").between(*YEAR_DAYS)
    base = spans.groupBy(*keys).agg(F.max("end").alias("latest"), F.max(F.when(year, F.struct("end", -F.unix_date("start"), "val"))).alias("fiscal"))
    base = base.select(*keys, "latest", F.col("fiscal.end").alias("fiscal_end"), F.col("fiscal.val").alias("fiscal_val"))
    to_date = (F.col("end") == F.col("latest")) & (F.abs(F.datediff("start", "fiscal_end") - 1) <= 4)
    current = spans.join(base.filter("fiscal_end < latest"), keys).filter(to_date).groupBy(*keys).agg(F.max(F.struct("n_days", "val")).alias("now_"), F.first("latest").alias("latest"))
    target = current.select(*keys, F.date_sub("latest", 364).alias("aim"), F.col("now_.n_days").alias("aim_days"), F.col("now_.val").alias("now_val"))
    rolled = nearest(target, spans, keys, 12).select(*keys, (F.col("now_val") - F.col("near.val")).alias("gain"))
    last = Window.partitionBy(*keys).orderBy(F.desc("end"), "start")
    four = spans.filter(F.col("n_days").between(*QUARTER_DAYS)).withColumn("rn", F.row_number().over(last)).filter("rn <= 4")
    four = four.groupBy(*keys).agg(F.sum("val").alias("four_val"), F.max("end").alias("four_end"), F.min("end").alias("four_first"), F.count("*").alias("n")).filter((F.col("n") == 4) & (F.datediff("four_end", "four_first") <= 290))
    rows = base.join(rolled, keys, "left").join(four, keys, "left")
    yearly, roll, quarters = F.col("fiscal_end") >= F.col("latest"), F.col("gain").isNotNull(), F.col("four_end").isNotNull()
    ttm = F.when(yearly, F.col("fiscal_val")).when(roll, F.col("fiscal_val") + F.col("gain")).when(quarters, F.col("four_val")).otherwise(F.col("fiscal_val"))
    end = F.when(yearly, F.col("fiscal_end")).when(roll, F.col("latest")).when(quarters, F.col("four_end")).otherwise(F.col("fiscal_end"))
    return rows.select(*keys, ttm.alias("ttm"), end.alias("ttm_end")).filter("ttm_end is not null")


def latest_quarter(facts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, quarter, quarter_end, before): the last quarter and the same one a year earlier, null where there is none.

    A fourth quarter that isn't reported is its year less the nine months that begin with the year.
    """
    spans = facts.filter("start is not null").withColumn("n_days", _days()).select(*keys, "start", "end", "val", "filed", "n_days")
    quarters = spans.filter(F.col("n_days").between(*QUARTER_DAYS))
    years = spans.filter(F.col("n_days").between(*YEAR_DAYS)).select(*keys, F.col("start").alias("y_start"), F.col("end").alias("y_end"), F.col("val").alias("y_val"), F.col("filed").alias("y_filed"), F.date_sub("end", 91).alias("aim"), (F.col("n_days") - 91).alias("aim_days"))
    fourth = nearest(years, spans, keys, 15).filter("near.start = y_start")
    fourth = fourth.select(*keys, F.date_add("near.end", 1).alias("start"), F.col("y_end").alias("end"), (F.col("y_val") - F.col("near.val")).alias("val"), F.col("y_filed").alias("filed"))
    fourth = fourth.join(quarters.select(*keys, "end"), [*keys, "end"], "left_anti").withColumn("n_days", _days())
    every = quarters.unionByName(fourth)
    last = every.groupBy(*keys).agg(F.max(F.struct("end", -F.unix_date("start"), "n_days", "val")).alias("l"))
    last = last.select(*keys, F.col("l.end").alias("quarter_end"), F.col("l.val").alias("quarter"), F.date_sub("l.end", 364).alias("aim"), F.col("l.n_days").alias("aim_days"))
    before = nearest(last, every, keys, 15).select(*keys, F.col("near.val").alias("before"))
    return last.select(*keys, "quarter", "quarter_end").join(before, keys, "left")


def figures(facts: DataFrame, company: str, metric: str = "metric") -> DataFrame:
    """(company, metric, ttm, ttm_end, quarter, quarter_end, growth, margin) of every metric that a company still reports.

    A figure older than STALE_FIGURE_DAYS next to the company's newest goes, and the growth with it; growth is null where
    the earlier quarter is missing or 0; the margin of income metrics is their year over the revenue's, if that is positive.
    """
    keys = [company, metric]
    rows = trailing_year(facts, keys).join(latest_quarter(facts, keys), keys, "full_outer")
    newest = F.max(F.greatest("ttm_end", "quarter_end")).over(Window.partitionBy(company))
    rows = rows.withColumn("newest", newest)
    fresh = lambda c: F.coalesce(F.datediff("newest", c) <= STALE_FIGURE_DAYS, F.lit(False))
    current = fresh("quarter_end") & F.coalesce(F.datediff("newest", "ttm_end") <= STALE_FIGURE_DAYS, F.lit(True))
    growth = F.when(current & (F.col("before") != 0), (F.col("quarter") - F.col("before")) / F.abs("before"))
    rows = rows.select(*keys, *[F.when(fresh(f"{c}_end"), F.col(x)).alias(x) for c in ("ttm", "quarter") for x in (c, f"{c}_end")], growth.alias("growth"))
    revenue = F.max(F.when(F.col(metric) == "revenue", F.col("ttm"))).over(Window.partitionBy(company))
    margin = F.when(F.col(metric).isin("net_income", "operating_income") & (revenue > 0), F.col("ttm") / revenue)
    return rows.withColumn("margin", margin).filter("ttm is not null or quarter is not null")


def shares_outstanding(counts: DataFrame, company: str) -> DataFrame:
    """(company, shares, shares_as_of): all share classes of the latest day together. counts has (company, end, val)."""
    by_day = counts.filter("`end` is not null").groupBy(company, "end").agg(F.sum("val").alias("val"))
    return by_day.groupBy(company).agg(F.max(F.struct("end", "val")).alias("l")).select(company, F.col("l.val").alias("shares"), F.col("l.end").alias("shares_as_of"))


def derived(prices: DataFrame, known: DataFrame, today: Column) -> DataFrame:
    """(ticker, price, price_date, high_52w, low_52w, market_cap, pe). known has (ticker, currency, shares, eps).

    Capitalisation and price/earnings only for prices in USD, the currency of the figures, and positive earnings.
    """
    year = prices.filter((F.col("price_date") >= F.date_sub(today, RANGE_DAYS)) & (F.col("price_date") <= today))
    p = year.groupBy("ticker").agg(F.max(F.struct("price_date", "close_price")).alias("l"), F.max("close_price").alias("high_52w"), F.min("close_price").alias("low_52w"))
    rows = known.join(p, "ticker", "left").withColumn("price", F.col("l.close_price").cast("double"))
    usd = (F.upper("currency") == "USD") & (F.col("price") != 0)
    return rows.select("ticker", "price", F.col("l.price_date").alias("price_date"), "high_52w", "low_52w", F.when(usd, F.col("price") * F.col("shares")).alias("market_cap"), F.when(usd & (F.col("eps") > 0), F.col("price") / F.col("eps")).alias("pe"))


@dataclass(frozen=True)
class Exposure:
    """Parts of every position: by company (account_id, key, name, via, eur, sector, other) and by country (account_id, country, eur)."""

    parts: DataFrame
    countries: DataFrame

    def companies(self) -> DataFrame:
        """(account_id, key, name, direct, total, share, other, warned): a company held both ways is one row."""
        by_key = self.parts.groupBy("account_id", "key").agg(F.min(F.struct(F.col("via").isNotNull(), "name")).alias("n"), F.sum(F.when(F.col("via").isNull(), F.col("eur")).otherwise(0.0)).alias("direct"), F.sum("eur").alias("total"), F.bool_and("other").alias("other"))
        share = F.try_divide(F.col("total"), F.sum("total").over(Window.partitionBy("account_id")))
        rows = by_key.select("account_id", "key", "n.name", "direct", "total", F.coalesce(share, F.lit(0.0)).alias("share"), "other")
        return rows.withColumn("warned", ~F.col("other") & (F.col("share") >= WARN_SHARE))

    def sectors(self) -> DataFrame:
        return _listing(self.parts, "sector")

    def by_country(self) -> DataFrame:
        return _listing(self.countries, "country")


def _listing(parts: DataFrame, key: str) -> DataFrame:
    sums = parts.groupBy("account_id", key).agg(F.sum("eur").alias("eur"))
    return sums.withColumn("share", F.coalesce(F.try_divide(F.col("eur"), F.sum("eur").over(Window.partitionBy("account_id"))), F.lit(0.0)))


def exposure(positions: DataFrame, facts: DataFrame, holdings: DataFrame, countries: DataFrame, cash: DataFrame) -> Exposure:
    """Looks through funds to what they hold; commodities, funds not loaded and cash are buckets of their own.

    positions (account_id, ticker, name, isin, value, fund, asset): fund names a loaded report or one that is missing,
    asset a commodity; rows without a positive value take no part. facts (ticker, country, sector); holdings (fund, key,
    name, pct, sector); countries (fund, country, pct); cash (account_id, eur). A fund's holdings are spread over tasks
    by the join on fund, never gathered.
    """
    p = positions.filter("value > 0")
    reported = holdings.filter("pct > 0").groupBy("fund").agg((F.sum("pct") / 100).alias("covered"))
    loaded = holdings.select("fund").unionByName(countries.select("fund")).distinct().withColumn("loaded", F.lit(True))
    p = p.join(loaded, "fund", "left").join(reported, "fund", "left")
    asset, fund = F.col("asset").isNotNull(), F.col("asset").isNull() & F.col("fund").isNotNull()
    plain = p.filter(~asset & ~fund).join(facts, "ticker", "left")
    nothing, text = F.lit(None).cast("string"), F.lit("Unclassified")
    part = lambda df, key, name, via, eur, sector, other: df.select("account_id", key.alias("key"), name.alias("name"), via.alias("via"), eur.alias("eur"), sector.alias("sector"), F.lit(other).alias("other"))
    seen = p.filter(fund & F.col("loaded"))
    inside = seen.select("account_id", "ticker", "fund", "value").join(holdings.filter("pct > 0"), "fund")
    rest = seen.withColumn("rest", 1 - F.coalesce("covered", F.lit(0.0))).filter("rest > 0")
    unseen = p.filter(fund & F.col("loaded").isNull())
    money = cash.filter("eur > 0")
    c, value = F.col, F.col("value")
    pieces = [
        part(p.filter(asset), F.concat(F.lit("asset:"), "asset"), c("asset"), nothing, value, F.lit("Commodities"), False),
        part(unseen, F.concat(F.lit("fund:"), "ticker"), F.concat("name", F.lit(" (holdings not loaded yet)")), nothing, value, text, True),
        part(inside, c("key"), c("name"), c("ticker"), value * c("pct") / 100, F.coalesce("sector", text), False),
        part(rest, F.concat(F.lit("other:"), "ticker"), F.concat(F.lit("Other holdings of "), "name"), c("ticker"), value * c("rest"), text, True),
        part(plain, F.coalesce(cusip(c("isin")), c("ticker")), c("name"), nothing, value, F.coalesce("sector", text), False),
        part(money, F.lit("cash"), F.lit("Cash"), nothing, c("eur"), F.lit("Cash"), True),
    ]
    whole = countries.groupBy("fund").agg(F.sum("pct").alias("whole"))
    spread = seen.select("account_id", "fund", "value").join(countries, "fund").join(whole, "fund").select("account_id", "country", (value * c("pct") / F.coalesce(F.nullif("whole", F.lit(0.0)), F.lit(100.0))).alias("eur"))
    where = [
        spread,
        p.filter(asset).select("account_id", F.lit("Commodity").alias("country"), value.alias("eur")),
        unseen.select("account_id", F.lit("Unknown").alias("country"), value.alias("eur")),
        plain.select("account_id", F.coalesce(F.nullif("country", F.lit("")), F.left(F.coalesce("isin", F.lit("??")), F.lit(2))).alias("country"), value.alias("eur")),
        money.select("account_id", F.lit("Cash").alias("country"), "eur"),
    ]
    union = lambda dfs: dfs[0] if len(dfs) == 1 else dfs[0].unionByName(union(dfs[1:]))
    return Exposure(union(pieces), union(where))
