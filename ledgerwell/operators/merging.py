"""One batch of news merged: of items that tell the same story the one in front stays, as if taken in order one by one.

Two items are in conflict if their addresses are equal, or if their titles are and their times lie within the window or
one has none. An item stays if no better one that stays is in conflict with it. That is settled in rounds: an item
without a better undecided one in conflict with it stays, what is in conflict with it goes, until all are decided.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwell.functions.storage import stored

#: When so few rows are undecided, one task decides them in order; a chain of ever better neighbours needs a round a link.
FINISH_ROWS = 100_000


def merge_batch(items: DataFrame, window_hours: int = 48, finish_rows: int = FINISH_ROWS) -> DataFrame:
    """(item_id) of the rows of items(item_id, canonical, title, ts, trust, headline) that stay; item_id is unique.

    Better is more trusted, then dated, newer, and first by headline, canonical and item_id. A blank title and a null
    address are in conflict with nothing. Titles are cut into slots of one window's length, so that all of a slot are in
    conflict and one title is never one task; other slots meet only as the least and greatest time of each trust.
    """
    window = window_hours * 3_600_000_000
    ts, text = F.unix_micros("ts"), lambda c: F.coalesce(c, F.lit(""))
    order = F.struct(-F.coalesce("trust", F.lit(0)), ts.isNull(), -ts, text("headline"), text("canonical"), F.col("item_id"))
    open_rows = items.select("item_id", "canonical", F.nullif("title", F.lit("")).alias("title"), ts.alias("ts"), F.coalesce("trust", F.lit(0)).alias("trust"), order.alias("k"), F.floor(ts / window).alias("slot"))
    kept: list[DataFrame] = []
    while True:
        open_rows = stored(open_rows, "undecided")
        n = open_rows.count()
        if n <= finish_rows:
            break
        stays = stored(_unbeaten(open_rows, window), "stays")
        kept.append(stays.select("item_id"))
        open_rows = _without_conflicts(open_rows, stays, window)
    if n or not kept:
        kept.append(_in_order(open_rows, window))
    out = kept[0]
    for more in kept[1:]:
        out = out.unionByName(more)
    return out


def _first(rows: DataFrame, *keys: str) -> DataFrame:
    """The best row of each key, whole."""
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in keys]), "k").alias("r")).select(*keys, "r.*")


def _unbeaten(rows: DataFrame, window: int) -> DataFrame:
    """Rows without a better one in conflict with them: best of their address, and of their title within the window."""
    by_address = _first(rows.filter("canonical is not null"), "canonical").select("item_id").unionByName(rows.filter("canonical is null").select("item_id"))
    titled = rows.filter("title is not null")
    undated = titled.filter("slot is null").groupBy("title").agg(F.min("k").alias("undated_k"))
    whole = titled.groupBy("title").agg(F.min("k").alias("title_k"))
    of_slot = _first(titled.filter("slot is not null"), "title", "slot").join(undated, "title", "left").filter("undated_k is null or k < undated_k").drop("undated_k")
    # of the slots beside: the later one has better rows of equal trust, the earlier one only more trusted ones
    beside = titled.filter("slot is not null").groupBy("title", "slot", "trust").agg(F.min("ts").alias("least"), F.max("ts").alias("greatest"))
    beside = beside.select("title", "trust", "least", "greatest", F.col("slot").alias("at"), F.explode(F.array(F.col("slot") - 1, F.col("slot") + 1)).alias("slot")).withColumnRenamed("trust", "other")
    later = (F.col("at") > F.col("slot")) & (F.col("other") >= F.col("trust")) & (F.col("least") <= F.col("ts") + window)
    earlier = (F.col("at") < F.col("slot")) & (F.col("other") > F.col("trust")) & (F.col("greatest") >= F.col("ts") - window)
    beaten = of_slot.join(beside, ["title", "slot"]).filter(later | earlier).select("item_id").distinct()
    dated = of_slot.join(beaten, "item_id", "left_anti").select(*rows.columns)
    alone = _first(titled.filter("slot is null"), "title").join(whole, "title").filter("k = title_k").select(*rows.columns)
    by_title = dated.unionByName(alone).unionByName(rows.filter("title is null"))
    return by_title.join(by_address, "item_id", "left_semi")


def _without_conflicts(rows: DataFrame, stays: DataFrame, window: int) -> DataFrame:
    """rows but for those that stay and what is in conflict with them."""
    rest = rows.join(stays.filter("canonical is not null").select("canonical"), "canonical", "left_anti").join(stays.select("item_id"), "item_id", "left_anti")
    titles = stays.filter("title is not null").groupBy("title").agg(F.bool_or(F.col("slot").isNull()).alias("undated"))
    rest = rest.join(titles, "title", "left").filter("undated is null or (slot is not null and not undated)").drop("undated")
    near = stays.filter("title is not null and slot is not null").select("title", F.col("ts").alias("kept_ts"), F.explode(F.array(F.col("slot") - 1, F.col("slot"), F.col("slot") + 1)).alias("slot"))
    return rest.alias("r").join(near.alias("n"), (F.col("r.title") == F.col("n.title")) & (F.col("r.slot") == F.col("n.slot")) & (F.abs(F.col("r.ts") - F.col("kept_ts")) <= window), "left_anti").select(*rows.columns)


def _in_order(rows: DataFrame, window: int) -> DataFrame:
    """The rows that stay, taken one by one in one task."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        addresses, dated, undated = set(), {}, set()
        for batch in batches:
            kept = []
            for i, address, title, ts in zip(*(c.to_pylist() for c in batch.columns[:4]), strict=True):
                if address is not None and address in addresses:
                    continue
                times = dated.setdefault(title, []) if title is not None else []
                if title is not None:
                    at = bisect_left(times, ts - window) if ts is not None else 0
                    if title in undated or (times and ts is None) or (at < len(times) and times[at] <= ts + window):
                        continue
                    undated.add(title) if ts is None else times.insert(bisect_left(times, ts), ts)
                addresses.add(address)
                kept.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(kept, batch.schema.field(0).type)], names=["item_id"])

    ordered = rows.select("item_id", "canonical", "title", "ts", "k").coalesce(1).sortWithinPartitions("k").drop("k")
    return ordered.mapInArrow(take, rows.select("item_id").schema)
