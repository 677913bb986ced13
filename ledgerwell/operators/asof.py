"""As-of joins: bounded carry-forward as an equi join, unbounded ones as windows over both sides, month by month."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXACT, CARRIED = "EXACT", "FORWARD_FILL"


def carry_forward(series: DataFrame, keys: list[str], day: str, max_stale_days: int) -> DataFrame:
    """series with a row for each day on which its values hold: until the next row, at most max_stale_days later.

    Adds seen_on (the day of the value) and provenance. A join on keys and day then is the bounded as-of join, without a
    range condition; the rows grow by max_stale_days + 1 at most.
    """
    after = F.lead(day).over(Window.partitionBy(*keys).orderBy(day))
    last = F.least(F.date_add(day, max_stale_days), F.coalesce(F.date_sub(after, 1), F.date_add(day, max_stale_days)))
    out = series.withColumn("seen_on", F.col(day)).withColumn("last_", last)
    out = out.withColumn(day, F.explode(F.sequence(F.col("seen_on"), F.col("last_")))).drop("last_")
    return out.withColumn("provenance", F.when(F.col(day) == F.col("seen_on"), F.lit(EXACT)).otherwise(F.lit(CARRIED)))


def first_seen(series: DataFrame, keys: list[str], day: str) -> DataFrame:
    """The first day of each series: before it a value is missing, after it a value that isn't there is stale."""
    return series.groupBy(*keys).agg(F.min(day).alias("first_seen"))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_day: str, right_day: str, values: list[str], max_stale_days: int | None = None, or_next: bool = False) -> DataFrame:
    """left with the values of the last right row on or before its day, and found_on, that row's day.

    Older than max_stale_days counts as none. With or_next, where there is none, the first later row however late.
    """
    # a key is cut by months, so that no task sorts all rows of a key; each month knows the last value before it (and
    # the first one after it) from a small table with a row a key and month
    bucket = lambda c: F.trunc(c, "month").alias("bucket_")
    packed = F.struct(F.col(right_day).alias("found_on"), *[F.col(v) for v in values]).alias("hit_")
    a = left.select(*keys, F.col(left_day).alias("at_"), bucket(left_day), F.struct(*[F.col(c) for c in left.columns]).alias("row_"), F.lit(1).alias("side_"))
    b = right.filter(F.col(right_day).isNotNull()).select(*keys, F.col(right_day).alias("at_"), bucket(right_day), packed, F.lit(0).alias("side_"))
    months = a.select(*keys, "bucket_").unionByName(b.select(*keys, "bucket_")).distinct()
    ends = b.groupBy(*keys, "bucket_").agg(F.max_by("hit_", "at_").alias("last_"), F.min_by("hit_", "at_").alias("first_"))
    by_month = Window.partitionBy(*keys).orderBy("bucket_")
    same_month = F.col("m.bucket_").eqNullSafe(F.col("e.bucket_"))
    same_key = [F.col(f"m.{k}").eqNullSafe(F.col(f"e.{k}")) for k in keys]
    for k in same_key:
        same_month = same_month & k
    edges = months.alias("m").join(ends.alias("e"), same_month, "left").select("m.*", "e.last_", "e.first_")
    edges = edges.withColumn("hit_", F.last("last_", ignorenulls=True).over(by_month.rowsBetween(Window.unboundedPreceding, -1)))
    edges = edges.withColumn("next_", F.first("first_", ignorenulls=True).over(by_month.rowsBetween(1, Window.unboundedFollowing)))
    before_ = edges.filter("hit_ is not null").select(*keys, "bucket_", F.lit("0001-01-01").cast("date").alias("at_"), "hit_", F.lit(0).alias("side_"))
    after_ = edges.filter("next_ is not null").select(*keys, "bucket_", F.lit("9999-12-31").cast("date").alias("at_"), F.col("next_").alias("hit_"), F.lit(0).alias("side_"))
    both = a.unionByName(b.unionByName(before_).unionByName(after_), allowMissingColumns=True)
    order = Window.partitionBy(*keys, "bucket_").orderBy("at_", "side_")
    before = F.last("hit_", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    if max_stale_days is not None:
        before = F.when(F.datediff("at_", before["found_on"]) <= max_stale_days, before)
    found = before
    if or_next:
        later = Window.partitionBy(*keys, "bucket_").orderBy("at_", F.desc("side_"))
        found = F.coalesce(before, F.first("hit_", ignorenulls=True).over(later.rowsBetween(0, Window.unboundedFollowing)))
    return both.withColumn("found_", found).filter("side_ = 1").select("row_.*", "found_.found_on", *[F.col("found_")[v].alias(v) for v in values])


def eur_rate(currency: Column, quoted: Column) -> Column:
    """1 for the base currency, else the quoted rate."""
    return F.when(currency == "EUR", F.lit(1).cast("decimal(18,12)")).otherwise(quoted.cast("decimal(18,12)"))
