"""Instruments as they were seen, filled up from metadata and cache, resolved to market symbols and stored as seeds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("isin", "name", "currency", "instrument_type")
#: Codes of exchanges in the United States.
US_EXCHANGES = ("US", "UA", "UN", "UQ", "UR", "UW")


def _given(c: str) -> Column:
    return F.nullif(F.col(c), F.lit(""))


def observed(*sources: DataFrame) -> DataFrame:
    """(ticker, isin, name, currency, instrument_type): each field's first value over the sources, in their order.

    Each source has those columns and `seen`, its own order; blanks count as missing. One aggregate takes all fields.
    """
    parts = [s.select("ticker", "seen", *[_given(c).alias(c) for c in FIELDS], F.lit(i).alias("source_")) for i, s in enumerate(sources)]
    rows = reduce(DataFrame.unionByName, parts).filter("ticker is not null")
    return rows.groupBy("ticker").agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("source_", "seen"))).alias(c) for c in FIELDS])


def enriched(seen: DataFrame, metadata: DataFrame, cached: DataFrame) -> DataFrame:
    """seen with its missing fields from metadata, else from the cache; both have one row a ticker."""
    part = lambda df, name: df.select("ticker", F.struct(*[_given(c).alias(c) for c in FIELDS]).alias(name))
    rows = seen.join(part(metadata, "m_"), "ticker", "left").join(part(cached, "c_"), "ticker", "left")
    return rows.select("ticker", *[F.coalesce(c, F.col("m_")[c], F.col("c_")[c]).alias(c) for c in FIELDS])


def resolved(instruments: DataFrame, overrides: DataFrame, answers: DataFrame) -> DataFrame:
    """(ticker, status, source, symbol, candidates) of instruments(ticker, isin, currency, ...).

    overrides(isin, symbol); answers(isin, error, candidates) of the symbol service, candidates an array of
    struct(ticker, exchange), one row an isin. Without an isin or a usable answer it is unresolved; an override wins.
    Only dollar instruments are resolved by themselves: by the one ticker that American exchanges have for them.
    """
    a = answers.select("isin", F.lit(True).alias("answered_"), "error", F.coalesce("candidates", F.array().cast("array<struct<ticker:string,exchange:string>>")).alias("c_"))
    rows = instruments.select("ticker", F.col("isin"), F.upper("currency").alias("currency")).join(overrides.select("isin", F.col("symbol").alias("o_")), "isin", "left").join(a, "isin", "left")
    american = lambda c: F.coalesce(c["exchange"].isin(*US_EXCHANGES), F.lit(False))
    distinct = lambda cs: F.array_distinct(F.filter(F.transform(cs, lambda c: c["ticker"]), lambda t: t.isNotNull()))
    rows = rows.withColumn("us_", F.filter(distinct(F.filter("c_", american)), lambda t: t != "")).withColumn("all_", distinct(F.col("c_"))).withColumn("n_", F.coalesce(F.size("c_"), F.lit(0)))
    elsewhere = F.exists("c_", lambda c: c["exchange"].isNotNull() & ~c["exchange"].isin(*US_EXCHANGES))
    none = F.col("answered_").isNull() | F.col("error").isNotNull() | (F.col("n_") == 0)
    status = (
        F.when(F.col("isin").isNull(), "unresolved").when(F.col("o_").isNotNull(), "resolved").when(none, "unresolved").when(F.coalesce("currency", F.lit("")) != "USD", "override_required")
        .when(F.size("us_") == 1, "resolved").when((F.size("us_") > 1) | (F.size("all_") > 1), "ambiguous").when(elsewhere, "override_required").otherwise("unresolved")
    )
    source = F.when(F.col("isin").isNull(), "missing_isin").when(F.col("o_").isNotNull(), "override").otherwise("service")
    out = rows.withColumn("status", status).withColumn("source", source)
    symbol = F.when(F.col("source") == "override", F.col("o_")).when(F.col("status") == "resolved", F.replace(F.get("us_", F.lit(0)), F.lit("."), F.lit("-")))
    asked = (F.col("source") == "service") & F.col("error").isNull()
    return out.select("ticker", "status", "source", symbol.alias("symbol"), F.when(asked, F.col("n_")).otherwise(0).alias("candidates"))


def seeds(seen: DataFrame, metadata: DataFrame, mapping: DataFrame) -> DataFrame:
    """(ticker, fields, observed, status, source, symbol): metadata where there is some, else as seen; unseen ones need no symbol."""
    m = metadata.select("ticker", *[F.col(c).alias(f"m_{c}") for c in FIELDS], F.lit(True).alias("meta_"))
    s = seen.join(mapping.select("ticker", "status", "source", "symbol"), "ticker", "left").withColumn("observed", F.lit(True))
    rows = s.join(m, "ticker", "full_outer")
    fields = [F.when(F.col("meta_"), F.col(f"m_{c}")).otherwise(F.col(c)).alias(c) for c in FIELDS]
    unseen = F.col("observed").isNull()
    return rows.select("ticker", *fields, F.coalesce("observed", F.lit(False)).alias("observed"), F.when(unseen, "not_required").otherwise(F.col("status")).alias("status"), F.when(~unseen, F.col("source")).alias("source"), F.when(~unseen, F.col("symbol")).alias("symbol"))
