"""Configuration files: what is read, and what is refused and why."""

import pytest

from ledgerwell.sources import config as cf


def written(tmp_path, **files):
    for name, text in files.items():
        (tmp_path / f"{name}.yaml").write_text(text)
    return str(tmp_path)


def faults(spark, path, kind):
    return {(r["file"].rsplit("/", 1)[1], r["place"]): r["fault"] for r in cf.judged(cf.read_entries(spark, path, kind), kind).collect()}


def test_feeds(spark, tmp_path):
    entry = lambda **kv: "  - " + "\n    ".join(f"{k}: {v}" for k, v in kv.items()) + "\n"
    path = written(
        tmp_path,
        a="feeds:\n" + entry(key="a", label="A", url="https://x/1") + entry(key="b", label="B", url_template="https://x/{isin}", trust=90, tickers="[T1, T2]", enabled="false")
        + entry(key="c", label="C", provider="marketaux") + entry(key="d", label="D", url_template="https://x/static") + entry(key="e", label="E", url="file:///etc") + entry(key="f", label="F") + entry(key="on", label="On", url="https://x")
        + entry(key="g", label="G", url="https://x", colour="red") + entry(key="h", label='" "', url="https://x") + entry(key="i", label="I", url="https://x", provider="other") + entry(key="j", label="J", url="https://x", url_template="https://{ticker}"),
        b="feeds:\n" + entry(key="dup", label="One", url="https://x/1") + entry(key="dup", label="Two", url="https://x/2"), c="", d="other: 1\n", e="feeds: [1, {", f="- a\n",
    )
    got = faults(spark, path, "feeds")
    assert [got["a.yaml", i] for i in range(11)] == [
        None, None, None, "url_template must contain a placeholder", "url must be http or https", "needs exactly one of url and url_template", "key is of another type", "unknown field colour", "label is missing or blank", "unknown provider",
        "needs exactly one of url and url_template",
    ]
    assert got["b.yaml", 0] == got["b.yaml", 1] == "key is there more than once" and got["d.yaml", 0] == "unknown field other" and got["e.yaml", 0] == "no YAML" and got["f.yaml", 0].startswith("no mapping")
    assert not any(k[0] == "c.yaml" for k in got)
    with pytest.raises(ValueError, match="url_template must contain"):
        cf.checked(spark, path, "feeds")
    (tmp_path / "good").mkdir()
    good = written(tmp_path / "good", a="feeds:\n" + entry(key="a", label="A", url="https://x/1") + entry(key="b", label="B", url_template="https://x/{isin}", trust=90, tickers="[T1, T2]") + entry(key="hidden", label="O", url="https://x/2", enabled="false"))
    assert [(r["key"], r["trust"], r["tickers"]) for r in cf.checked(spark, good, "feeds").orderBy("key").collect()] == [("a", 50, None), ("b", 90, ["T1", "T2"])]


def test_benchmarks_and_overrides(spark, tmp_path):
    sector = lambda name, weight, **more: "\n        ".join([f"      - sector: {name}", f"weight: {weight}", "proxy_symbol: XLE", "proxy_currency: usd", *[f"{k}: {v}" for k, v in more.items()]]).replace("\n        ", "\n        ") + "\n"
    bench = lambda key, *sectors, source="sheet": f"  {key}:\n    as_of: 2024-01-31\n    source: {source}\n    sectors:\n" + "".join(sectors)
    one, other = cf.BENCHMARKS[:2]
    path = written(tmp_path, a="benchmarks:\n" + bench(one, sector("Energy", "0.4"), sector("Health", "0.6049")) + bench(other, sector("Energy", "0.4"), sector("Health", "0.6051")), b="benchmarks:\n" + bench("nobody", sector("A", 1)), c="benchmarks:\n" + bench(one, sector("A", 1, extra=1)), d="benchmarks:\n" + bench(one, sector("A", "0.5"), sector("A", "0.5")), e="benchmarks:\n" + bench(one, sector("A", "1.5"), sector("B", "-0.5")))
    got = faults(spark, path, "benchmarks")
    assert [got["a.yaml", i] for i in range(4)] == [None, None, "weights do not sum to 1", "weights do not sum to 1"]
    assert got["b.yaml", 0] == "unknown benchmark" and got["c.yaml", 0] == "unknown field extra" and got["d.yaml", 0] == got["d.yaml", 1] == "sector is there more than once"
    assert sorted([got["e.yaml", 0], got["e.yaml", 1]]) == ["another sector of the benchmark is refused", "weight is negative"]
    (tmp_path / "o").mkdir()
    rows = "overrides:\n  - isin: US88160R1014\n    yahooTicker: TSLA\n    preferredExchange: NASDAQ\n    quoteCurrency: USD\n    reason: Seen.\n  - isin: US0846707026\n    yahoo_ticker: BRK-B\n    preferred_exchange: NYSE\n    quote_currency: USD\n    reason: Same.\n    news_keywords: [Berkshire]\n"
    good = written(tmp_path / "o", a=rows)
    assert [(r["yahoo_ticker"], r["preferred_exchange"], r["news_keywords"]) for r in cf.checked(spark, good, "overrides").orderBy("place").collect()] == [("TSLA", "NASDAQ", None), ("BRK-B", "NYSE", ["Berkshire"])]
    written(tmp_path / "o", b=rows)
    assert set(faults(spark, good, "overrides").values()) == {"isin is there more than once"}
