"""Configuration files as tables: feeds, weights of benchmarks' sectors and overrides, and every entry that is refused.

Files are read by Spark, wherever they are kept, one task a file; a task turns YAML into plain entries. The rules are
column expressions over these, so a faulty entry is a row with a reason and doesn't hide the others.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerwell.operators.feeds import PLACEHOLDERS

#: The fields of each kind of entry with their types, other spellings, and the providers and benchmarks there are.
FIELDS = {
    "feeds": {"key": "string", "label": "string", "provider": "string", "url": "string", "url_template": "string", "tickers": "array<string>", "isins": "array<string>", "enabled": "boolean", "trust": "bigint", "user_agent": "string", "contact_required": "boolean"},
    "overrides": {"isin": "string", "yahoo_ticker": "string", "preferred_exchange": "string", "quote_currency": "string", "reason": "string", "sector": "string", "news_keywords": "array<string>"},
    "benchmarks": {"benchmark": "string", "as_of": "date", "source": "string", "sector": "string", "weight": "decimal(18,10)", "proxy_symbol": "string", "proxy_currency": "string"},
}
ALIASES = {"yahooTicker": "yahoo_ticker", "preferredExchange": "preferred_exchange", "quoteCurrency": "quote_currency"}
NEEDED = {"feeds": ("key", "label"), "overrides": ("isin", "yahoo_ticker", "preferred_exchange", "quote_currency", "reason"), "benchmarks": ("benchmark", "as_of", "source", "sector", "weight", "proxy_symbol", "proxy_currency")}
PROVIDERS = {"rss": 50, "marketaux": 60}
BENCHMARKS = ("cspx", "swda", "vwrp")
OWN_URL, SCHEMES = "marketaux", ("http", "https")
TOLERANCE = 0.005

ENTRY = "file string, place int, entry string, fault string"


def _entries(text: str, kind: str) -> list[tuple[dict, str | None]]:
    """Entries of one file, flat, each with a fault of its shape; a sector of a benchmark is an entry."""
    import yaml

    try:
        document = yaml.safe_load(text)
    except yaml.YAMLError:
        return [({}, "no YAML")]
    if document is None:
        return []
    if not isinstance(document, dict):
        return [({}, f"no mapping with the key {kind}")]
    strange = sorted(str(k) for k in document if k != kind)
    if strange:
        return [({}, f"unknown field {strange[0]}")]
    found = document.get(kind) or []
    if kind != "benchmarks":
        return [(x, None) if isinstance(x, dict) else ({}, "no mapping") for x in found] if isinstance(found, list) else [({}, "no list")]
    if not isinstance(found, dict):
        return [({}, "no mapping")]
    out = []
    for key, b in found.items():
        sectors = b.get("sectors") if isinstance(b, dict) else None
        strange = sorted(str(k) for k in b if k not in ("as_of", "source", "sectors")) if isinstance(b, dict) else []
        if strange or not isinstance(sectors, list) or not sectors:
            out.append(({"benchmark": key}, f"unknown field {strange[0]}" if strange else "no sectors"))
            continue
        head = {"benchmark": key, "as_of": b.get("as_of"), "source": b.get("source")}
        out += [({**x, **head}, None) if isinstance(x, dict) else (head, "no mapping") for x in sectors]
    return out


def _fits(value, kind: str) -> bool:
    if value is None:
        return True
    if kind.startswith("array"):
        return isinstance(value, list) and all(isinstance(v, str) for v in value)
    if kind == "boolean":
        return isinstance(value, bool)
    if kind == "bigint":
        return isinstance(value, int) and not isinstance(value, bool)
    if kind == "date":
        return isinstance(value, datetime.date)
    if kind.startswith("decimal"):
        return isinstance(value, (int, float, str)) and not isinstance(value, bool)
    return isinstance(value, str)


def read_entries(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(file, place, fields of the kind, fault) of the files at path; fault is null for an entry of the right shape."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for place, (entry, fault) in enumerate(_entries(text, kind)):
                    named = {ALIASES.get(k, k) if isinstance(k, str) else str(k): v for k, v in entry.items()}
                    strange = sorted(k for k in named if k not in FIELDS[kind])
                    wrong = [k for k, t in FIELDS[kind].items() if not _fits(named.get(k), t)]
                    fault = fault or (f"unknown field {strange[0]}" if strange else f"{wrong[0]} is of another type" if wrong else None)
                    kept = {k: str(v) if isinstance(v, (datetime.date, float)) or (isinstance(v, int) and not isinstance(v, bool)) else v for k, v in named.items() if k in FIELDS[kind] and k not in wrong}
                    rows.append((file, place, json.dumps(kept), fault))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.string()))], names=["file", "place", "entry", "fault"])

    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))
    kinds = {k: t if t.startswith("array") or t == "boolean" else "string" for k, t in FIELDS[kind].items()}
    entry = F.from_json("entry", ", ".join(f"`{k}` {t}" for k, t in kinds.items()))
    rows = files.mapInArrow(parse, ENTRY).withColumn("e", entry)
    typed = [F.trim(F.col(f"e.{k}")).try_cast(t).alias(k) if kinds[k] == "string" else F.col(f"e.{k}").alias(k) for k, t in FIELDS[kind].items()]
    return rows.select("file", "place", *typed, "fault")


def _first_fault(*tests: tuple[Column, str]) -> Column:
    return F.coalesce("fault", *[F.when(F.coalesce(test, F.lit(False)), reason) for test, reason in tests])


def judged(entries: DataFrame, kind: str) -> DataFrame:
    """entries with `fault` by all rules: needed fields, repeated keys, addresses, known names, sums of weights."""
    blank = [(F.coalesce(F.col(k).cast("string"), F.lit("")) == "", f"{k} is missing or blank") for k in NEEDED[kind]]
    if kind == "feeds":
        own = F.col("provider") == OWN_URL
        address = F.coalesce("url", "url_template")
        marked = F.lit(False)
        for mark in PLACEHOLDERS:
            marked = marked | F.contains(F.col("url_template"), F.lit(mark))
        twice = F.count("*").over(Window.partitionBy("key")) > 1
        e = entries.withColumn("provider", F.coalesce("provider", F.lit("rss"))).withColumn("twice_", twice)
        tests = [
            *blank, (~F.col("provider").isin(*PROVIDERS), "unknown provider"), (own & address.isNotNull(), "this provider makes its own url"), (~own & (F.col("url").isNull() == F.col("url_template").isNull()), "needs exactly one of url and url_template"),
            (F.col("url_template").isNotNull() & ~marked, "url_template must contain a placeholder"), (address.isNotNull() & ~F.lower(F.regexp_extract(address, "^([A-Za-z][A-Za-z0-9+.-]*):", 1)).isin(*SCHEMES), "url must be http or https"), (F.col("twice_"), "key is there more than once"),
        ]
        trust = F.create_map(*[F.lit(x) for kv in PROVIDERS.items() for x in kv])
        return e.withColumn("fault", _first_fault(*tests)).withColumn("trust", F.coalesce("trust", F.element_at(trust, F.col("provider")).cast("long"))).withColumn("enabled", F.coalesce("enabled", F.lit(True))).drop("twice_")
    if kind == "overrides":
        twice = F.count("*").over(Window.partitionBy("isin")) > 1
        return entries.withColumn("twice_", twice).withColumn("fault", _first_fault(*blank, (F.col("twice_"), "isin is there more than once"))).drop("twice_")
    of_one = Window.partitionBy("file", "benchmark")
    e = entries.withColumn("total_", F.sum("weight").over(of_one)).withColumn("twice_", F.count("*").over(Window.partitionBy("file", "benchmark", "sector")) > 1).withColumn("proxy_currency", F.upper("proxy_currency"))
    tests = [*blank, (~F.col("benchmark").isin(*BENCHMARKS), "unknown benchmark"), (F.col("weight") < 0, "weight is negative"), (F.col("twice_"), "sector is there more than once"), (F.abs(F.col("total_") - 1) > F.lit(str(TOLERANCE)).cast("decimal(18,10)"), "weights do not sum to 1")]
    e = e.withColumn("fault", _first_fault(*tests)).drop("total_", "twice_")
    # a benchmark is taken whole or not at all
    return e.withColumn("fault", F.coalesce("fault", F.when(F.count("fault").over(of_one) > 0, "another sector of the benchmark is refused")))


def checked(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The entries of the files at path; raises with the first faults if there are any. Feeds that are off are left out."""
    rows = judged(read_entries(spark, path, kind), kind)
    bad = rows.filter("fault is not null").orderBy("file", "place").limit(20).collect()
    if bad:
        raise ValueError("; ".join(f"{r['file']}, entry {r['place']}: {r['fault']}" for r in bad))
    return rows.filter("enabled").drop("fault") if kind == "feeds" else rows.drop("fault")
