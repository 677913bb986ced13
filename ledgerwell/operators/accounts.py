"""What an account's pages list: plans, weights with what is known of a holding, flags, freshness, requests and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerwell.functions.storage import drop_path, files_of

#: The most that a plan's weights may sum up to, and what a holding's context names.
MOST_WEIGHT, CONTEXT_NEWS = 1.0001, 5
#: Hours after which earnings, and days after which dividends are fetched again, and how many of these a run takes.
EARNINGS_HOURS, DIVIDEND_DAYS, DIVIDENDS_A_RUN = 20, 7, 4


def replace_plans(existing: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plans (account_id, ticker, weight) after replacement, and refused (account_id, total).

    An account in incoming loses all its targets and gets the positive new ones, unless they sum up to more than
    MOST_WEIGHT: then it keeps the old ones.
    """
    sums = incoming.groupBy("account_id").agg(F.sum("weight").alias("total"))
    over = sums.filter(F.col("total") > MOST_WEIGHT)
    taken = sums.filter(F.col("total") <= MOST_WEIGHT).select("account_id")
    kept = existing.join(taken, "account_id", "left_anti")
    return kept.unionByName(incoming.filter("weight > 0").join(taken, "account_id", "left_semi").select(*kept.columns)), over


def holding_context(holdings: DataFrame, news: DataFrame) -> DataFrame:
    """(account_id, ticker, weight, n_news, latest_headline) of the holdings of the last day that have a value.

    weight is null where an account's values sum up to 0; of news(ticker, ts, headline) the CONTEXT_NEWS newest count.
    """
    last = holdings.groupBy("account_id").agg(F.max("as_of_date").alias("as_of_date"))
    rows = holdings.join(last, ["account_id", "as_of_date"], "left_semi").filter("market_value_eur is not null").withColumn("v_", F.col("market_value_eur").cast("double"))
    totals = rows.groupBy("account_id").agg(F.sum("v_").alias("total_"))
    newest = news.withColumn("rn_", F.row_number().over(Window.partitionBy("ticker").orderBy(F.col("ts").desc_nulls_last(), "headline"))).filter(F.col("rn_") <= CONTEXT_NEWS)
    told = newest.groupBy("ticker").agg(F.count("*").alias("n_news"), F.min_by("headline", "rn_").alias("latest_headline"))
    out = rows.join(totals, "account_id").join(told, "ticker", "left")
    return out.select("account_id", "ticker", F.when(F.col("total_") != 0, F.col("v_") / F.col("total_")).alias("weight"), F.coalesce("n_news", F.lit(0)).alias("n_news"), "latest_headline")


def is_fresh(status: Column, last_success: Column, now: Column, hours: int) -> Column:
    return F.coalesce((status == "success") & (F.unix_micros(now) - F.unix_micros(last_success) <= hours * 3_600_000_000), F.lit(False))


def news_targets(follow: DataFrame, instruments: DataFrame) -> DataFrame:
    """Instruments that someone holds or watches, once each."""
    return instruments.join(follow.select("ticker").distinct(), "ticker", "left_semi")


def ticker_of_symbol(rows: DataFrame, instruments: DataFrame, symbol: str, translated: Column) -> DataFrame:
    """rows with the ticker whose symbol, as a provider writes it, is theirs; of several the last by ticker. Others go."""
    known = instruments.select(translated.alias(symbol), "ticker").filter(F.col(symbol).isNotNull() & (F.col(symbol) != "")).groupBy(symbol).agg(F.max("ticker").alias("ticker"))
    return rows.join(known, symbol)


def with_flags(rows: DataFrame, watched: DataFrame, held: DataFrame) -> DataFrame:
    """rows (account_id, ticker, ...) with `watched` and `held`."""
    keys = ["account_id", "ticker"]
    mark = lambda df, name: df.select(*keys).distinct().withColumn(name, F.lit(True))
    return rows.join(mark(watched, "watched"), keys, "left").join(mark(held, "held"), keys, "left").fillna(False, ["watched", "held"])


def due(fetches: DataFrame, now: Column) -> DataFrame:
    """(kind, ticker) to be fetched again of fetches(kind, ticker, fetched_at), null if it never was.

    All earnings older than EARNINGS_HOURS; of dividends older than DIVIDEND_DAYS the DIVIDENDS_A_RUN oldest, never fetched ones first.
    """
    age = lambda hours: F.col("fetched_at").isNull() | (F.col("fetched_at") <= now - F.expr(f"interval {hours} hours"))
    earnings = fetches.filter((F.col("kind") == "earnings") & age(EARNINGS_HOURS)).select("kind", "ticker")
    dividends = fetches.filter((F.col("kind") == "dividends") & age(24 * DIVIDEND_DAYS)).orderBy(F.col("fetched_at").asc_nulls_first(), "ticker").limit(DIVIDENDS_A_RUN)
    return earnings.unionByName(dividends.select("kind", "ticker"))


def price_requests(instruments: DataFrame, benchmarks: DataFrame, proxies: DataFrame) -> DataFrame:
    """(cache_key, symbol, currency, kind) of all prices wanted: instruments with a symbol, benchmarks and sector proxies.

    The keys of the latter are put in underscores, which no ticker is. A proxy of several sectors is asked for once.
    """
    part = lambda df, key, kind: df.select(key.alias("cache_key"), "symbol", "currency", F.lit(kind).alias("kind"))
    wanted = part(instruments.filter("symbol is not null and symbol <> ''"), F.col("ticker"), "instrument")
    wanted = wanted.unionByName(part(benchmarks, F.concat(F.lit("__benchmark_"), "key", F.lit("__")), "benchmark"))
    sector = proxies.groupBy(F.upper(F.trim("symbol")).alias("symbol")).agg(F.min("currency").alias("currency"))
    return wanted.unionByName(part(sector, F.concat(F.lit("__sector_proxy_"), "symbol", F.lit("__")), "sector"))


def plain_symbol(ticker: Column) -> Column:
    """NVDA of NVDA_US_EQ, VUAG of VUAGl_EQ: what stands before the first underscore, without small letters at its end if more is left."""
    base = F.substring_index(ticker, "_", 1)
    return F.coalesce(F.nullif(F.regexp_replace(base, "[a-z]+$", ""), F.lit("")), base)


def listed(rows: DataFrame, order: list[Column], limit: int | None = None, **equal) -> DataFrame:
    """rows with the given values, in order; of all or the first `limit`. An order should end in a unique column."""
    for name, value in equal.items():
        rows = rows.filter(F.col(name).eqNullSafe(F.lit(value)))
    rows = rows.orderBy(*order)
    return rows if limit is None else rows.limit(limit)


def declared(overrides: DataFrame, field: str) -> DataFrame:
    """(isin, field) of the overrides that declare the field: a text that isn't blank, or a list that isn't empty."""
    kind = dict(overrides.dtypes)[field]
    given = F.size(field) > 0 if kind.startswith("array") else F.coalesce(F.trim(field), F.lit("")) != ""
    return overrides.filter(F.coalesce(given, F.lit(False))).select("isin", field)


def as_report(df: DataFrame, key: str, rename: dict[str, str] | None = None) -> DataFrame:
    """(key, report): each row as JSON with names in camel case; nulls stay."""
    camel = lambda name: name.split("_")[0] + "".join(w.capitalize() for w in name.split("_")[1:])
    fields = [F.col(c).alias((rename or {}).get(c, camel(c))) for c in df.columns]
    return df.select(key, F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("report"))


def table_stats(tables: dict[str, tuple[DataFrame, str | None]]) -> DataFrame:
    """(name, rows, bytes) of tables, each with the column whose bytes count, or none."""
    out = None
    for name, (df, text) in tables.items():
        size = F.coalesce(F.sum(F.octet_length(text)), F.lit(0)) if text else F.lit(0)
        one = df.agg(F.lit(name).alias("name"), F.count("*").alias("rows"), size.cast("long").alias("bytes"))
        out = one if out is None else out.unionByName(one)
    return out


def replace_table(df: DataFrame, folder: str) -> int:
    """Replace the table in a folder in one step: a new version beside the old one, which counts once it is written whole.

    Readers of the version before go on undisturbed; the one before that is deleted. Returns the version's number.
    """
    spark = df.sparkSession
    done = versions(spark, folder)
    number = max(done, default=0) + 1
    df.write.mode("overwrite").parquet(f"{folder}/version={number}")  # over what a failed write left
    for old in done[:-1]:
        drop_path(spark, f"{folder}/version={old}")
    return number


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Versions that were written whole."""
    return sorted(int(p.split("version=")[1].split("/")[0]) for p in files_of(spark, f"{folder}/version=*") if p.endswith("/_SUCCESS"))


def current_table(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/version={versions(spark, folder)[-1]}")
