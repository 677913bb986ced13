"""Factor model, clusters and streams against numpy and hand-worked cases."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerwell.operators import markets as mk
from ledgerwell.operators import news as nw
from ledgerwell.streaming import events as st


def test_factor_model_matches_least_squares(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 6)) / 50
    y = x @ np.array([1.1, -0.2, 0.3, 0, 0.5, -0.7]) + 0.001 + rng.normal(size=80) / 500
    rows = [("a", *map(float, r), float(v)) for r, v in zip(x, y, strict=True)] + [("few", *[0.1] * 6, 0.1)] * 5 + [("same", float(r[0]), float(r[0]), *map(float, r[2:]), float(v)) for r, v in zip(x, y, strict=True)]
    out = {r.k: r for r in mk.factor_model(spark.createDataFrame(rows, ["k", *mk.FACTORS, "y"]), ["k"]).collect()}
    want = np.linalg.lstsq(np.column_stack([np.ones(80), x]), y, rcond=None)[0]
    assert [out["a"]["alpha"], *[out["a"][f] for f in mk.FACTORS]] == pytest.approx(want.tolist(), abs=1e-8)
    left = y - np.column_stack([np.ones(80), x]) @ want
    assert out["a"].r2 == pytest.approx(1 - left @ left / ((y - y.mean()) ** 2).sum(), abs=1e-9)
    assert out["few"].status == "insufficient_data" and out["few"].alpha is None
    twice = np.column_stack([np.ones(80), x[:, 0], x[:, 0], x[:, 2:]])
    least = np.linalg.lstsq(twice, y, rcond=None)[0]
    assert (twice @ np.array([out["same"]["alpha"], *[out["same"][f] for f in mk.FACTORS]])) == pytest.approx(twice @ least, abs=1e-8)


def test_clusters_of_two_groups(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(2, 40))
    rows = [("a", dt.date(2024, 1, 1) + dt.timedelta(days=i), f"t{k}", float(base[k // 3][i] + rng.normal() / 10)) for k in range(6) for i in range(40)]
    rows += [("flat", dt.date(2024, 1, 1) + dt.timedelta(days=i), t, 0.0) for t in "xy" for i in range(40)] + [("few", dt.date(2024, 1, 1), t, 0.1) for t in "xy"]
    pairs = mk.correlations(spark.createDataFrame(rows, "account_id string, as_of_date date, ticker string, ret double"))
    got = {r.ticker: r.cluster for r in mk.clusters(pairs, 0.7).collect()}
    assert got == {"t0": 0, "t1": 0, "t2": 0, "t3": 1, "t4": 1, "t5": 1}


def test_news_keys(spark):
    rows = [("HTTPS://WWW.Example.com:443/a/B/?utm_x=1&b=2&a=1&c=#f",), ("http://x.org",), ("http://x.org:8080//?ref=1",), ("no url",), (None,)]
    got = [r.c for r in spark.createDataFrame(rows, "u string").select(nw.canonical_url(F.col("u")).alias("c")).collect()]
    assert got == ["https://example.com/a/B?a=1&b=2", "http://x.org/", "http://x.org:8080/", None, None]
    times = ["2024-01-31T08:30:00Z", "2024-01-31T10:30:00+02:00", "2024-01-31T08:30:00", "Wed, 31 Jan 2024 08:30:00 GMT", "31 Jan 2024 09:30 +0100", "2024-01-31", "soon", None, "31 Foo 2024 08:30:00"]
    got = [r.t for r in spark.createDataFrame([(t,) for t in times], "u string").select(nw.iso_utc(nw.published_at(F.col("u"))).alias("t")).collect()]
    assert got == ["2024-01-31T08:30:00+00:00"] * 5 + ["2024-01-31T00:00:00+00:00", "", "", ""]


def test_streams_go_on_with_new_files(spark, tmp_path):
    schema = "k string, ts timestamp, v double"
    ts = lambda d, h=0: dt.datetime(2024, 1, d, h)
    spark.createDataFrame([("a", ts(1), 1.0), ("a", ts(1, 5), 2.0), ("b", ts(3), 4.0)], schema).write.parquet(f"{tmp_path}/in", mode="append")
    spark.createDataFrame([("a", ts(2), 8.0)], schema).write.parquet(f"{tmp_path}/in", mode="append")
    events = st.read_events(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema)
    sums = st.run_updates(st.window_sums(events, ["k"], "ts", "v", "1 day"), ["k", "window_start"], "t")
    assert sorted((r.k, r.window_start.day, r.total, r.n) for r in sums.collect()) == [("a", 1, 3.0, 2), ("a", 2, 8.0, 1), ("b", 3, 4.0, 1)]
    once = st.run_appends(st.once_only(events, F.col("k"), F.col("v") > 1, "ts"), "once")
    assert sorted(r.message for r in once.collect()) == ["a", "b"]


def _linked_plainly(names, distance, cut):
    groups = [[i] for i in range(len(names))]
    while len(groups) > 1:
        pairs = [(distance[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j]
        best = min(pairs)
        if best[0] > cut:
            break
        groups[best[1]] = groups[best[1]] + groups.pop(best[2])
    return {frozenset(names[i] for i in g) for g in groups}


def test_average_linkage_against_means_of_all_pairs():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 7, 25, 40):
        d = rng.random((n, n))
        d = (d + d.T) / 2
        np.fill_diagonal(d, 0)
        names = [f"t{i:02}" for i in range(n)]
        for cut in (0.2, 0.45, 0.6, 2):
            found = mk.average_linkage(names, d, cut)
            groups = {}
            for name, k in zip(names, found, strict=True):
                groups.setdefault(k, set()).add(name)
            assert {frozenset(g) for g in groups.values()} == _linked_plainly(names, d, cut)
            assert [min(groups[k]) for k in sorted(groups)] == sorted(min(g) for g in groups.values())
