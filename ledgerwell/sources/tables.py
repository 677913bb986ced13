"""Writing into tables that have rows already: upserts, inserts of what is new, replacements, and calendar files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """All rows by keys, incoming ones in place of existing; of incoming rows with equal keys the last in `order`."""
    if order is not None:
        incoming = incoming.withColumn("rn_", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).filter("rn_ = 1").drop("rn_")
    # merged by sorting: the size of computed keys is guessed too low, and a broadcast of them would pass through the driver
    return existing.join(incoming.select(*keys).hint("merge"), keys, "left_anti").unionByName(incoming)


def insert_new(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """existing and those rows of incoming whose key is new; of equal new keys one row."""
    return existing.unionByName(incoming.join(existing.select(key), key, "left_anti").dropDuplicates([key]))


def fill_in(existing: DataFrame, incoming: DataFrame, keys: list[str], text: list[str], status: str, final: str = "resolved") -> DataFrame:
    """Rows of both: new texts where they are known, else the old; a status that is final stays so."""
    a, b = existing.alias("a"), incoming.alias("b")
    out = a.join(b.select(*keys, *[F.col(c).alias(f"new_{c}") for c in [*text, status]]), keys, "full_outer")
    kept = F.when(F.col(status) == final, F.col(status)).otherwise(F.coalesce(F.col(f"new_{status}"), F.col(status)))
    return out.select(*keys, *[F.coalesce(F.col(f"new_{c}"), F.col(c)).alias(c) for c in text], kept.alias(status))


def replace_future(existing: DataFrame, incoming: DataFrame, key: str, day: str, today: str) -> DataFrame:
    """incoming in place of the days from today on of the keys that it has; all else stays."""
    future = F.col(day) >= F.lit(today).cast("date")
    had = existing.join(incoming.select(key).distinct().withColumn("again_", F.lit(True)), key, "left")
    return had.filter(~(future & F.coalesce("again_", F.lit(False)))).drop("again_").unionByName(incoming)


def _escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for sign in (";", ","):
        out = F.replace(out, F.lit(sign), F.lit(f"\\{sign}"))
    return F.regexp_replace(out, r"\r?\n", r"\\n")


def _folded(line: Column) -> Column:
    """Lines of at most 74 signs; a following one begins with a space."""
    return F.concat(F.left(line, F.lit(74)), F.regexp_replace(F.substr(line, F.lit(75), F.length(line)), "(?s)(.{1,73})", "\r\n $1"))


def calendar_entries(events: DataFrame, stamp: str, domain: str = "ledgerwell.local") -> DataFrame:
    """(id, day, entry): each event (id, day, summary, description) as an entry of a calendar file, with a stable id."""
    part = lambda name, value: F.concat(F.lit(name), value)
    day = lambda c: F.date_format(c, "yyyyMMdd")
    lines = [
        F.lit("BEGIN:VEVENT"), part("UID:", F.concat(F.replace(F.col("id"), F.lit(":"), F.lit("-")), F.lit(f"@{domain}"))), F.lit(f"DTSTAMP:{stamp}"), part("DTSTART;VALUE=DATE:", day(F.col("day"))),
        part("DTEND;VALUE=DATE:", day(F.date_add("day", 1))), _folded(part("SUMMARY:", _escape(F.col("summary")))), _folded(part("DESCRIPTION:", _escape(F.col("description")))), F.lit("TRANSP:TRANSPARENT"), F.lit("END:VEVENT"),
    ]
    return events.select("id", "day", F.concat_ws("\r\n", *lines).alias("entry"))
