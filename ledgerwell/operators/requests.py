"""What goes to and comes from providers: symbols in each one's form, endpoints, replay admission, messages, data quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What follows the last dot of a listing's symbol, and each provider's name of that exchange.
LONDON, LONDON_NAME, LONDON_SUFFIX = "L", "LSE", "LON"
EXCHANGES = {
    "": "US", "L": "LSE", "IL": "IL", "DE": "XETRA", "F": "F", "PA": "PA", "AS": "AS", "BR": "BR", "LS": "LS", "MI": "MI", "MC": "MC", "SW": "SW", "VI": "VI", "ST": "ST", "CO": "CO", "OL": "OL",
    "HE": "HE", "IR": "IR", "TO": "TO", "V": "V", "HK": "HK", "AX": "AU", "T": "TSE",
}
#: Paths of endpoints and their category.
ENDPOINTS = {"/equity/metadata/instruments": "metadata", "/equity/positions": "positions", "/equity/history/orders": "orders", "/equity/history/dividends": "dividends", "/equity/history/transactions": "transactions"}
UNREADY = ("unresolved", "ambiguous", "override_required")
UNBALANCED = ("MISMATCH", "UNSUPPORTED_ACTION")


def _split(symbol: Column) -> tuple[Column, Column]:
    """What stands before and after the last dot; no suffix where there is no dot or nothing before it."""
    before, after = F.regexp_extract(symbol, r"(?s)^(.+)\.([^.]*)$", 1), F.upper(F.regexp_extract(symbol, r"(?s)^(.+)\.([^.]*)$", 2))
    dotted = before != ""
    return F.when(dotted, before).otherwise(symbol), F.when(dotted, after)


def provider_symbols(symbol: Column) -> Column:
    """struct(plain, plain_exchange, suffixed, coded): a listing in the forms of three providers.

    Only London is known to the first two; the third refuses (null) an exchange that it has no code for.
    """
    base, suffix = _split(symbol)
    london = F.coalesce(suffix == LONDON, F.lit(False))
    code = F.element_at(F.create_map(*[F.lit(x) for kv in EXCHANGES.items() for x in kv if kv[0]]), suffix)
    code = F.when(suffix.isNull(), EXCHANGES[""]).otherwise(code)
    return F.struct(F.when(london, base).otherwise(symbol).alias("plain"), F.when(london, LONDON_NAME).alias("plain_exchange"), F.when(london, F.concat(base, F.lit("." + LONDON_SUFFIX))).otherwise(symbol).alias("suffixed"), F.concat(base, F.lit("."), code).alias("coded"))


def classified_endpoint(endpoint: Column) -> Column:
    """struct(category, path) of a stored endpoint: a path, with a query, or a whole address."""
    path = F.regexp_replace(F.regexp_replace(endpoint, r"^([A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*", ""), r"(?s)[?#].*$", "")
    path = F.regexp_replace(path, "^/api/v0/", "/")
    category = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ENDPOINTS.items() for x in kv]), path), F.lit("unknown"))
    return F.struct(category.alias("category"), F.coalesce(F.nullif(path, F.lit("")), endpoint).alias("path"))


def replay_skips(category: Column, status: Column) -> Column:
    """Why a stored response isn't replayed; null if it is."""
    refused = F.concat(F.lit("non-2xx response (status "), status.cast("string"), F.lit(")"))
    live = "live-state endpoint (current positions); not history, so it is not replayed"
    return F.when((status < 200) | (status >= 300), refused).when(category == "positions", live).when(category == "unknown", "unsupported or unrecognised endpoint for replay")


def redacted(message: Column) -> Column:
    """A provider's message with any key in it masked."""
    return F.regexp_replace(message, r"(?i)(api[ _-]?key(?:\s+as|\s*[=:])?\s*)[A-Za-z0-9_\-]{8,}", "$1[redacted]")


def overall_status(endpoints: DataFrame, instruments: DataFrame, positions: DataFrame, fresh: Column, key: str) -> DataFrame:
    """(key, overall, failed, unready, unbalanced) of each account with endpoints: ERROR if one failed, WARNING if its
    metadata is stale (`fresh`, a column of endpoints, true on some row), an instrument isn't resolved or a position is off."""
    e = endpoints.groupBy(key).agg(F.count_if(F.col("last_status") == "failed").alias("failed"), F.bool_or(F.coalesce(fresh, F.lit(False))).alias("is_fresh"))
    i = instruments.groupBy(key).agg(F.count_if(F.col("status").isin(*UNREADY)).alias("unready"))
    p = positions.groupBy(key).agg(F.count_if(F.col("status").isin(*UNBALANCED)).alias("unbalanced"))
    rows = e.join(i, key, "left").join(p, key, "left").na.fill(0, ["unready", "unbalanced"])
    overall = F.when(F.col("failed") > 0, "ERROR").when(~F.col("is_fresh") | (F.col("unready") + F.col("unbalanced") > 0), "WARNING").otherwise("OK")
    return rows.select(key, overall.alias("overall"), "failed", "unready", "unbalanced")
