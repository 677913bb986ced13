"""Charges that recur and ranges of future values: steps that depend on the order, as numpy in tasks."""

from __future__ import annotations

import math
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerwell.functions.money import js_round

#: How far an amount may be from its cluster's median, days between charges that count, parts of an interval.
SAME_AMOUNT, LEAST_GAP, REGULAR_GAPS, OFF_BEAT, REGULAR_SHARE = 0.15, 3, (6, 400), 0.25, 0.7
OVERDUE, YOUNG, DEARER, DAYS_PER_MONTH = 1.5, 2.5, 1.01, 30.44
#: Days from, to, the cadence's name and its charges a month.
CADENCES = ((6, 8, "Weekly", 52 / 12), (13, 16, "Every 2 weeks", 26 / 12), (26, 35, "Monthly", 1.0), (80, 100, "Quarterly", 1 / 3), (340, 390, "Yearly", 1 / 12))
#: The seed of the paths and the step of their generator's state.
SEED, STEP, PATHS = 20260928, 0x6D2B79F5, 2000


def amount_clusters(charges: DataFrame, keys: list[str]) -> DataFrame:
    """charges (keys, ts, amount, ...) with `cluster`: in order of time, each joins the first whose median is about its amount.

    One task sees the charges of one key, so keys must name one card and one merchant, not a merchant of all cards.
    Equal times go by amount. A cluster's number is the order in which it began.
    """

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "amount"], kind="stable")
        # each cluster's amounts in order, so that its median is read from their middle
        ordered: list[list[float]] = []
        middles = np.zeros(0)
        found = np.empty(len(pdf), dtype=np.int32)
        for i, amount in enumerate(pdf["amount"].tolist()):
            near = np.flatnonzero(np.abs(amount - middles) <= middles * SAME_AMOUNT)
            found[i] = home = int(near[0]) if len(near) else len(ordered)
            if home == len(ordered):
                ordered.append([])
                middles = np.append(middles, 0.0)
            mine = ordered[home]
            insort(mine, amount)
            half = len(mine) // 2
            middles[home] = mine[half] if len(mine) % 2 else (mine[half - 1] + mine[half]) / 2
        return pdf.assign(cluster=found)

    rows = charges.drop("cluster")
    return rows.groupBy(*keys).applyInPandas(assign, T.StructType([*rows.schema.fields, T.StructField("cluster", T.IntegerType())]))


def _cadence(days: Column) -> tuple[Column, Column]:
    label = F.concat(F.lit("Every ~"), F.floor(days + 0.5).cast("string"), F.lit(" days"))
    monthly = F.lit(DAYS_PER_MONTH) / days
    for low, high, name, rate in CADENCES:
        inside = days.between(low, high)
        label, monthly = F.when(inside, name).otherwise(label), F.when(inside, F.lit(rate)).otherwise(monthly)
    return label, monthly


def recurring(charges: DataFrame, keys: list[str], now: str) -> DataFrame:
    """(keys, cadence, interval_days, amount, previous_amount, monthly_cost, n, first, last, next, status) of regular charges.

    charges has (keys, ts, amount above 0). Charges of about one amount recur if none is within LEAST_GAP days of the next
    and two are a month or a year apart, or three and more keep to their median gap mostly. Status: lapsed, price-up,
    new or active at `now`. Rows of amount null, 0 or below, or without a time, take no part.
    """
    rows = amount_clusters(charges.filter("amount > 0 and ts is not null").select(*keys, F.col("ts").cast("timestamp").alias("ts"), F.col("amount").cast("double").alias("amount")), keys)
    per = rows.groupBy(*keys, "cluster").agg(F.array_sort(F.collect_list(F.struct("ts", "amount"))).alias("c")).filter(F.size("c") >= 2)
    day = lambda t: F.unix_micros(t) / 86_400e6
    gaps = F.transform(F.sequence(F.lit(2), F.size("c")), lambda i: day(F.get("c", i - 1)["ts"]) - day(F.get("c", i - 2)["ts"]))
    per = per.withColumn("gaps", gaps).withColumn("sorted_", F.array_sort("gaps"))
    half, n_gaps = F.floor(F.size("gaps") / 2).cast("int"), F.size("gaps")
    median = F.when(n_gaps % 2 == 1, F.get("sorted_", half)).otherwise((F.get("sorted_", half - 1) + F.get("sorted_", half)) / 2)
    per = per.withColumn("interval_days", median).filter(F.get("sorted_", F.lit(0)) >= LEAST_GAP)
    beat = F.col("interval_days")
    steady = F.size(F.filter("gaps", lambda g: F.abs(g - beat) <= beat * OFF_BEAT)) >= F.ceil(n_gaps * F.lit(REGULAR_SHARE))
    pair = beat.between(26, 35) | beat.between(340, 390)
    per = per.filter(F.when(n_gaps == 1, pair).otherwise(beat.between(*REGULAR_GAPS) & steady))
    latest, before, first, last = F.get("c", F.size("c") - 1)["amount"], F.get("c", F.size("c") - 2)["amount"], F.get("c", F.lit(0))["ts"], F.get("c", F.size("c") - 1)["ts"]
    at, (label, monthly) = day(F.lit(now).cast("timestamp")), _cadence(beat)
    young = (n_gaps == 1) & (at - day(first) < beat * YOUNG)
    status = F.when(at - day(last) > beat * OVERDUE, "lapsed").when(latest > before * DEARER, "price-up").when(young, "new").otherwise("active")
    # A calendar's next month overflows into the one after where it has no such day.
    month = lambda n: F.timestamp_micros(F.unix_micros(F.add_months(F.trunc(last, "month"), n).cast("timestamp")) + F.unix_micros(last) - F.unix_micros(F.trunc(last, "month").cast("timestamp")))
    following = F.when(label == "Monthly", month(1)).when(label == "Yearly", month(12)).otherwise(F.timestamp_micros((F.unix_micros(last) + F.floor(beat * 86_400_000) * 1000).cast("long")))
    previous = F.when(F.abs(latest - before) >= 0.01, js_round(before))
    return per.select(*keys, label.alias("cadence"), "interval_days", js_round(latest).alias("amount"), previous.alias("previous_amount"), js_round(latest * monthly).alias("monthly_cost"), F.size("c").alias("n"), first.alias("first"), last.alias("last"), following.alias("next"), status.alias("status"))


def draws(index: np.ndarray, seed: int) -> np.ndarray:
    """The index-th numbers (from 0) in [0, 1) of a 32-bit generator whose state grows by STEP: any draw by itself."""
    low = np.uint64(0xFFFFFFFF)
    state = (np.uint64(seed) + (index.astype(np.uint64) + np.uint64(1)) * np.uint64(STEP)) & low
    t = ((state ^ (state >> np.uint64(15))) * (state | np.uint64(1))) & low
    t = t ^ ((t + ((t ^ (t >> np.uint64(7))) * (t | np.uint64(61)) & low)) & low)
    return (t ^ (t >> np.uint64(14))).astype(np.float64) / 4294967296.0


def value_ranges(plans: DataFrame, key: str, paths: int = PATHS, seed: int = SEED) -> DataFrame:
    """(key, month, low, median, high, contributed) of each plan (key, start, monthly, yearly, volatility, years).

    Months grow by lognormal returns, then the month's payment is added; low and high are the 10th and 90th percentile
    of the paths. Every path of every plan is a row of its own, so they spread over tasks; draw k of the sequence belongs
    to one month and path, so the fan is the same however rows are placed. Years below a month count as one.
    """
    months = F.greatest(F.lit(1), F.floor(F.col("years") * 12 + 0.5).cast("int"))
    rows = plans.select(key, *[F.col(c).cast("double").alias(c) for c in ("start", "monthly", "yearly", "volatility")], months.alias("months"))
    each = rows.withColumn("path", F.explode(F.sequence(F.lit(0), F.lit(paths - 1)))).repartition(key, "path")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for start, monthly, yearly, volatility, n, path in pdf[["start", "monthly", "yearly", "volatility", "months", "path"]].itertuples(index=False):
                first = 2 * (np.arange(n, dtype=np.uint64) * np.uint64(paths) + np.uint64(path))
                u, v = np.maximum(draws(first, seed), 1e-12), draws(first + np.uint64(1), seed)
                sigma = volatility / math.sqrt(12)
                steps = np.exp(math.log(1 + yearly) / 12 - sigma * sigma / 2 + sigma * np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v))
                values, now = [start], start
                for step in steps:
                    now = now * step + monthly
                    values.append(now)
                out.append(values)
            yield pdf[[key, "start", "monthly"]].assign(vals=out)

    kind = plans.schema[key].dataType.simpleString()
    walked = each.mapInPandas(walk, f"{key} {kind}, start double, monthly double, vals array<double>")
    points = walked.select(key, (F.col("start")).alias("start"), "monthly", F.posexplode("vals").alias("month", "val"))
    ordered = points.groupBy(key, "start", "monthly", "month").agg(F.sort_array(F.collect_list("val")).alias("v"))  # `paths` values a month

    def share(p: float) -> Column:
        at = (paths - 1) * p
        low, high = F.get("v", F.lit(math.floor(at))), F.get("v", F.lit(math.ceil(at)))
        return low + (high - low) * F.lit(at - math.floor(at))

    return ordered.select(key, "month", share(0.1).alias("low"), share(0.5).alias("median"), share(0.9).alias("high"), (F.col("start") + F.col("monthly") * F.col("month")).alias("contributed"))
