"""Positions against the ledger, labels of exports, alerts, search, pages, and tables that overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerwell.operators import ledger as lg


def reconcile(live: DataFrame, fills: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(account_id, ticker, live_quantity, replayed_quantity, difference, status) of every ticker on either side.

    A ticker with any fill that the replay can't use is UNSUPPORTED_ACTION, whatever its quantities.
    """
    by = ["account_id", "ticker"]
    usable = F.coalesce(lg.admitted(fills), F.lit(False))
    f = fills.filter("ticker is not null")
    mine = live.groupBy(*by).agg(F.sum("quantity").alias("live_"))
    replayed = f.groupBy(*by).agg(F.sum(F.when(usable, lg.signed_quantity(F.col("side"), F.col("quantity")))).alias("replayed_"), F.max(~usable).alias("odd_"))
    j = mine.join(replayed, by, "full_outer")
    a, b = F.coalesce("live_", F.lit(0)), F.coalesce("replayed_", F.lit(0))
    status = F.when(F.col("odd_"), "UNSUPPORTED_ACTION").when(F.abs(a - b) <= tolerance, "MATCH").otherwise("MISMATCH")
    return j.select(*by, a.alias("live_quantity"), b.alias("replayed_quantity"), (a - b).alias("difference"), status.alias("status"))


def label_moves(moves: DataFrame, export: DataFrame) -> DataFrame:
    """moves with `action` from the export row of their reference; null where there is none."""
    return moves.join(export.groupBy(F.col("row_id").alias("reference")).agg(F.min("action").alias("action")), "reference", "left")


def unlabelled_withdrawals(moves: DataFrame, export: DataFrame) -> DataFrame:
    """Withdrawals (negative amounts) that no export row labels and that are no leg of a currency conversion."""
    legs = lg.conversion_legs(moves)
    out = moves.filter(F.upper("transaction_type").isin(*lg.OUT_TYPES) & (F.col("amount") < 0))
    return out.join(export.select(F.col("row_id").alias("reference")).distinct(), "reference", "left_anti").join(legs, ["account_id", "reference"], "left_anti")


def alert_met(kind: Column, threshold: Column, price: Column, cost: Column) -> Column:
    """Whether a quote fulfils an alert; gain and loss (in percent) need an average cost above zero."""
    change = F.when(cost > 0, (price / cost - 1) * 100)
    met = F.when(kind == "above", price >= threshold).when(kind == "below", price <= threshold).when(kind == "gain_pct", change >= threshold).when(kind == "loss_pct", change <= -threshold)
    return F.coalesce(met, F.lit(False))


def search(catalogue: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """(ticker, name, short_name, isin, rank): exact short names first, then ticker and name prefixes, then the rest."""
    asked = text.strip()
    if not asked:
        return catalogue.select("ticker", "name", "short_name", "isin", F.lit(0).alias("rank")).filter("false")
    up = asked.upper()
    holds = lambda c: F.contains(F.upper(c), F.lit(up))
    found = catalogue.filter(holds("name") | holds("short_name") | holds("ticker") | (F.col("isin") == up))
    rank = F.when(F.upper("short_name") == up, 0).when(F.startswith(F.upper("ticker"), F.lit(up + "_")), 1).when(F.startswith(F.upper("name"), F.lit(up)), 2).otherwise(3)
    return found.withColumn("rank", rank).orderBy("rank", F.length("name"), "ticker").limit(limit).select("ticker", "name", "short_name", "isin", "rank")


def page_of(rows: DataFrame, order: list[Column], page: float | None, size: int) -> DataFrame:
    """One page of rows in a total order, the number clamped to a page that exists.

    Spark's offset and limit take the page after one distributed sort; nothing is numbered in one task.
    """
    total = rows.count()
    pages = max(1, -(-total // size))
    wanted = 1 if page is None or page != page else int(page)
    return rows.orderBy(*order).offset((min(max(wanted, 1), pages) - 1) * size).limit(size)


def with_priority(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both; where keys are in both, only those of `second`."""
    return second.unionByName(first.join(second.select(*keys).distinct(), keys, "left_anti"))


def needs_fetch(wanted: DataFrame, prices: DataFrame, start: str, end: str, tolerance: int) -> DataFrame:
    """(ticker, reason) of wanted tickers whose prices are missing, begin too late or end too early."""
    have = prices.groupBy("ticker").agg(F.min("price_date").alias("lo"), F.max("price_date").alias("hi"))
    reason = F.when(F.col("lo").isNull(), "missing").when(F.col("lo") > F.date_add(F.lit(start).cast("date"), tolerance), "starts_late").when(F.col("hi") < F.date_sub(F.lit(end).cast("date"), tolerance), "ends_early")
    return wanted.join(have, "ticker", "left").select("ticker", reason.alias("reason")).filter("reason is not null")


def latest_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is last in order."""
    return rows.withColumn("rn_", F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))).filter("rn_ = 1").drop("rn_")
