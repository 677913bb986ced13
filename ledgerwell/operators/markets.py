"""Money-weighted return, factor models, correlation clusters, attribution and price moves."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerwell.functions.money import ANNUAL, ratio

#: The bracket of the money-weighted return and how often its upper end doubles at most.
RATE_LOW, RATE_HIGH, DOUBLINGS = -0.999999, 1.0, 12
#: Halvings of the bracket: it ends below a double's resolution of any root in it.
HALVINGS = 80
#: Windows of a price's move, and how many days late its history may begin.
PRICE_WINDOWS = ("1W", "1M", "3M", "6M", "YTD", "1Y", "ALL")
GRACE_DAYS = 7
FACTORS = ("mkt_rf", "smb", "hml", "rmw", "cma", "mom")
LEAST_FACTOR_ROWS, LEAST_COMMON_DAYS = 12, 20


def xirr(flows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, status, xirr, n) from (keys, day, amount): the annual rate (ACT/365) at which the flows are worth nothing.

    Statuses: insufficient_data (fewer than two flows), no_sign_change, no_bracket, ok. One row a key; a key's flows are
    one array (a flow a day at most after the sum here), and the root is found by halving, in expressions only.
    """
    daily = flows.groupBy(*keys, "day").agg(F.sum("amount").cast("double").alias("amount"))
    listed = daily.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("day", "amount"))).alias("f"), F.min("amount").alias("lo_"), F.max("amount").alias("hi_"))
    listed = listed.withColumn("f", F.transform("f", lambda x: F.struct((F.datediff(x["day"], F.col("f")[0]["day"]) / float(ANNUAL)).alias("y"), x["amount"].alias("a"))))
    worth = lambda rate: F.aggregate("f", F.lit(0.0), lambda acc, x: acc + x["a"] / F.pow(1 + rate, x["y"]))
    low = worth(F.lit(RATE_LOW))
    differs = lambda v: (v == 0) | (F.col("low_") == 0) | (F.col("low_") * v < 0)
    rows = listed.withColumn("low_", low)
    high = F.filter(F.transform(F.sequence(F.lit(0), F.lit(DOUBLINGS)), lambda k: F.struct((F.lit(RATE_HIGH) * F.pow(F.lit(2.0), k)).alias("r"))), lambda s: differs(worth(s["r"])))
    rows = rows.withColumn("high_", F.get(high, F.lit(0))["r"])
    start = F.struct(F.lit(RATE_LOW).alias("a"), F.col("high_").alias("b"))

    def halve(acc: Column, _: Column) -> Column:
        mid = (acc["a"] + acc["b"]) / 2
        left = F.col("low_") * worth(mid) <= 0
        return F.struct(F.when(left, acc["a"]).otherwise(mid).alias("a"), F.when(left, mid).otherwise(acc["b"]).alias("b"))

    root = F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), start, halve, lambda acc: (acc["a"] + acc["b"]) / 2)
    status = F.when(F.size("f") < 2, "insufficient_data").when((F.col("lo_") >= 0) | (F.col("hi_") <= 0), "no_sign_change").when(F.col("high_").isNull(), "no_bracket").otherwise("ok")
    return rows.withColumn("status", status).select(*keys, "status", F.when(F.col("status") == "ok", root).alias("xirr"), F.size("f").cast("long").alias("n"))


def account_flows(nav: DataFrame) -> DataFrame:
    """(account_id, day, amount): deposits as money out, withdrawals as money in, and the last known NAV as a last payment."""
    last = nav.filter("nav_eur is not null").groupBy("account_id").agg(F.max_by(F.struct("as_of_date", "nav_eur"), "as_of_date").alias("l"))
    upto = nav.join(last, "account_id").filter("as_of_date <= l.as_of_date and external_flow_eur <> 0").select("account_id", F.col("as_of_date").alias("day"), (-F.col("external_flow_eur")).cast("double").alias("amount"))
    return upto.unionByName(last.select("account_id", F.col("l.as_of_date").alias("day"), F.col("l.nav_eur").cast("double").alias("amount")))


def factor_rows(returns: DataFrame, factors: DataFrame) -> DataFrame:
    """Returns (account_id, as_of_date, twr) joined with the factors of their day, all six and rf known; y = twr - rf."""
    known = factors.dropna(subset=[*FACTORS, "rf"])
    return returns.join(known, "as_of_date").withColumn("y", F.col("twr") - F.col("rf"))


def factor_model(rows: DataFrame, keys: list[str], factors: tuple[str, ...] = FACTORS) -> DataFrame:
    """(keys, n, r2, alpha, one column a factor, status): least squares with an intercept, of least norm if factors coincide.

    Spark sums up the products of all pairs of columns, so a task gets one small matrix a key, never its rows.
    """
    names = ["one", *factors, "y"]
    rows = rows.withColumn("one", F.lit(1.0))
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.array(*[F.sum(F.col(a).cast("double") * F.col(b).cast("double")) for a, b in pairs]).alias("m"))
    m = len(names) - 1

    @F.pandas_udf("struct<beta:array<double>,r2:double>")
    def solve(products: pd.Series) -> pd.DataFrame:
        betas, shares = [], []
        for p in products:
            full = np.zeros((m + 1, m + 1))
            full[np.triu_indices(m + 1)] = p
            full = full + np.triu(full, 1).T
            scale = np.sqrt(np.where(np.diag(full)[:m] > 0, np.diag(full)[:m], 1))
            beta = np.linalg.pinv(full[:m, :m] / np.outer(scale, scale), rcond=1e-12) @ (full[:m, m] / scale) / scale
            total = full[m, m] - full[0, m] ** 2 / max(full[0, 0], 1)
            left = full[m, m] - 2 * beta @ full[:m, m] + beta @ full[:m, :m] @ beta
            betas.append(beta.tolist())
            shares.append(float(1 - left / total) if total > 1e-18 else None)
        return pd.DataFrame({"beta": betas, "r2": shares})

    enough = F.col("n") >= LEAST_FACTOR_ROWS
    out = sums.withColumn("s", solve("m"))
    return out.select(*keys, "n", *[F.when(enough, F.col("s.beta")[i]).alias("alpha" if i == 0 else names[i]) for i in range(m)], F.when(enough, F.col("s.r2")).alias("r2"), F.when(enough, "ok").otherwise("insufficient_data").alias("status"))


def correlations(returns: DataFrame) -> DataFrame:
    """(account_id, a, b, n, correlation) of each two holdings a < b of an account, over the days common to all of its holdings.

    Null where a series doesn't move. An account's holdings are few against its days, so pairs are sums over days.
    """
    held = returns.groupBy("account_id").agg(F.count_distinct("ticker").alias("held"))
    days = returns.groupBy("account_id", "as_of_date").agg(F.count_distinct("ticker").alias("there")).join(held, "account_id").filter("there = held").select("account_id", "as_of_date")
    common = returns.join(days, ["account_id", "as_of_date"], "left_semi")
    other = common.select("account_id", "as_of_date", F.col("ticker").alias("b"), F.col("ret").alias("rb"))
    pairs = common.select("account_id", "as_of_date", F.col("ticker").alias("a"), F.col("ret").alias("ra")).join(other, ["account_id", "as_of_date"]).filter("a < b")
    g = pairs.groupBy("account_id", "a", "b").agg(F.count("*").alias("n"), F.covar_samp("ra", "rb").alias("c"), F.stddev_samp("ra").alias("sa"), F.stddev_samp("rb").alias("sb"))
    return g.select("account_id", "a", "b", "n", F.when((F.col("sa") > 1e-12) & (F.col("sb") > 1e-12), F.col("c") / (F.col("sa") * F.col("sb"))).alias("correlation"))


def average_linkage(names: list[str], distance: np.ndarray, cut: float) -> list[int]:
    """Cluster numbers of names: the two nearest clusters (mean distance of their members) merge until none is nearer than cut.

    Of equal distances the first clusters merge. A merge is a few operations on the matrix of mean distances, which is as
    large as the pairs of holdings given; an account's holdings are hundreds at most.
    """
    n = len(names)
    members: dict[int, list[int]] = {i: [i] for i in range(n)}
    mean = np.where(np.triu(np.ones((n, n), bool), 1), distance, np.inf)  # of each two clusters, the lower number first
    nearest = mean.min(axis=1) if n else np.zeros(0)
    while len(members) > 1:
        i = int(nearest.argmin())
        j = int(mean[i].argmin())
        if mean[i, j] > cut:
            break
        a, b = len(members[i]), len(members[j])
        to_i, to_j = np.minimum(mean[i], mean[:, i]), np.minimum(mean[j], mean[:, j])
        both = (a * to_i + b * to_j) / (a + b)
        members[i] += members.pop(j)
        mean[j, :] = mean[:, j] = np.inf
        both[[i, j]] = np.inf
        mean[i, i + 1 :], mean[:i, i] = both[i + 1 :], both[:i]
        nearest = mean.min(axis=1)
    groups = list(members.values())
    groups.sort(key=lambda g: min(names[i] for i in g))
    number = {i: k for k, g in enumerate(groups) for i in g}
    return [number[i] for i in range(len(names))]


def clusters(pairs: DataFrame, cut: float = 0.7) -> DataFrame:
    """(account_id, ticker, cluster) from `correlations`, for accounts with enough common days and series that move.

    The distance of two holdings is sqrt(2 (1 - correlation)); clusters count up in the order of their first tickers.
    """
    usable = pairs.groupBy("account_id").agg(F.min("n").alias("least"), F.max(F.col("correlation").isNull()).alias("still")).filter(f"least >= {LEAST_COMMON_DAYS} and not still").select("account_id")

    def link(group: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*group["a"], *group["b"]})
        at, d = {t: i for i, t in enumerate(names)}, np.zeros((len(names), len(names)))
        i, j = group["a"].map(at).to_numpy(), group["b"].map(at).to_numpy()
        d[i, j] = d[j, i] = np.sqrt(np.maximum(2 * (1 - group["correlation"].to_numpy()), 0))
        return pd.DataFrame({"account_id": group["account_id"].iloc[0], "ticker": names, "cluster": np.array(average_linkage(names, d, cut), np.int32)})

    return pairs.join(usable, "account_id", "left_semi").groupBy("account_id").applyInPandas(link, "account_id string, ticker string, cluster int")


def price_moves(prices: DataFrame, keys: list[str], day: str = "price_date", close: str = "close_price") -> DataFrame:
    """(keys, window, start_date, change): the move to the last close from the last one on or before each window's start.

    A history that begins up to GRACE_DAYS after the start counts from its first close; a shorter one has no value.
    """
    ends = prices.groupBy(*keys).agg(F.max(day).alias("end_"), F.min(day).alias("begin_"))
    months = {"1M": 1, "3M": 3, "6M": 6, "1Y": 12}
    nominal = {w: F.add_months("end_", -n) for w, n in months.items()} | {"1W": F.date_sub("end_", 7), "YTD": F.date_sub(F.trunc("end_", "year"), 1), "ALL": F.col("begin_")}
    rows = prices.join(ends, keys)
    at = lambda w: F.max_by(F.struct(F.col(day).alias("d"), F.col(close).alias("c")), F.when(F.col(day) <= nominal[w], F.col(day)))
    agg = rows.groupBy(*keys, "end_", "begin_").agg(F.max_by(close, day).alias("last_"), F.min_by(close, day).alias("first_"), *[at(w).alias(f"w{w}") for w in PRICE_WINDOWS])
    first = F.struct(F.col("begin_").alias("d"), F.col("first_").alias("c"))
    start = lambda w: F.when(F.col("begin_") <= nominal[w], F.col(f"w{w}")).when(F.datediff("begin_", nominal[w]) <= GRACE_DAYS, first)
    out = agg.select(*keys, "last_", F.explode(F.array(*[F.struct(F.lit(w).alias("window"), start(w).alias("s")) for w in PRICE_WINDOWS])).alias("x"))
    return out.select(*keys, "x.window", F.col("x.s.d").alias("start_date"), (ratio(F.col("last_"), F.when(F.col("x.s.c") != 0, F.col("x.s.c"))) - 1).alias("change"))


def watchlist_change(prices: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, last_close, day_change, month_change): against the close before, and the last one a month or more before."""
    ends = prices.groupBy(*keys).agg(F.max("price_date").alias("end_"), F.count("*").alias("n_"))
    rows = prices.join(ends, keys)
    before = lambda cond: F.max_by("close_price", F.when(cond, F.col("price_date")))
    # max_by ignores no row by itself: where no row fits its order is null throughout, so such keys are told by a count
    prev, month = F.col("price_date") < F.col("end_"), F.col("price_date") <= F.add_months("end_", -1)
    g = rows.groupBy(*keys).agg(F.max_by("close_price", "price_date").alias("last_close"), F.when(F.count(F.when(prev, 1)) > 0, before(prev)).alias("p"), F.when(F.count(F.when(month, 1)) > 0, before(month)).alias("m"))
    change = lambda c: ratio(F.col("last_close"), F.when(F.col(c) != 0, F.col(c))) - 1
    return g.select(*keys, F.col("last_close").cast("double").alias("last_close"), change("p").alias("day_change"), change("m").alias("month_change"))


def sector_gates(weights: DataFrame, returns: DataFrame, sectors: DataFrame, proxies: DataFrame, most_unclassified: float = 0.1) -> DataFrame:
    """(account_id, status): why an attribution by sector is refused, or ok.

    From (account_id, ticker, weight), (account_id, ticker, ret), (ticker, sector) and (sector, rb). Refused are, in this
    order, accounts with a sector whose proxy has no return, with a holding that has none, and with too much unclassified.
    """
    rows = weights.join(sectors, "ticker", "left").join(returns, ["account_id", "ticker"], "left").join(proxies.withColumn("known", F.col("rb").isNotNull()), "sector", "left")
    g = rows.groupBy("account_id").agg(
        F.max(F.col("sector").isNotNull() & ~F.coalesce("known", F.lit(False))).alias("no_proxy"), F.max(F.col("ret").isNull()).alias("no_return"),
        (F.sum(F.when(F.col("sector").isNull(), F.col("weight")).otherwise(0.0)) / F.sum("weight")).alias("unclassified"),
    )
    status = F.when(F.col("no_proxy"), "missing_proxy").when(F.col("no_return"), "missing_return").when(F.col("unclassified") > most_unclassified, "unclassified").otherwise("ok")
    return g.select("account_id", "unclassified", status.alias("status"))


def attribution_report(effects: DataFrame, twr: DataFrame, benchmark_return: float) -> DataFrame:
    """(account_id, active, allocation, selection, interaction, residual): what the effects leave of the active return."""
    total = twr.groupBy("account_id").agg((F.product(1 + F.col("twr")) - 1).alias("growth"))
    sums = effects.groupBy("account_id").agg(*[F.sum(c).alias(c) for c in ("allocation", "selection", "interaction")])
    active = F.col("growth") - F.lit(benchmark_return)
    return sums.join(total, "account_id").select("account_id", active.alias("active"), "allocation", "selection", "interaction", (active - F.col("allocation") - F.col("selection") - F.col("interaction")).alias("residual"))


def growth_of_100(index: DataFrame) -> DataFrame:
    """index with growth: 100 at the first positive level of an account."""
    whole = Window.partitionBy("account_id")
    first = F.min_by(F.col("level"), F.when(F.col("level") > 0, F.col("as_of_date"))).over(whole)
    return index.withColumn("growth", F.when(F.max((F.col("level") > 0).cast("int")).over(whole) == 1, F.col("level") / first * 100)).select("account_id", "as_of_date", "growth")


def tail(rows: DataFrame, n: int) -> DataFrame:
    """The last n days of each account."""
    rn = F.row_number().over(Window.partitionBy("account_id").orderBy(F.desc("as_of_date")))
    return rows.withColumn("rn_", rn).filter(F.col("rn_") <= n).drop("rn_")
