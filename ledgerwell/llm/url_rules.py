"""URL filters: a sort-merge range join of urls with host and path prefix rules, in DataFrame operations only.

A rule (host, path) fits its host and all subdomains if the url's path starts with the rule's path. Written with the
host's labels reversed (`com#example#` + `/en/7`), a rule is a prefix and so an interval of sorted keys; a url has one
such key for each suffix of its host. Neither hosts nor paths hold a `#`, so keys can be read in one way only, whatever
labels are empty. Keys are sorted by their bytes. Intervals of prefixes are disjoint or nested, so a sweep with a stack
would push a rule at its start and pop it at its end. No stack is kept here, as one over all rules would need one task
that sees them all: the rule around each rule, what a pop uncovers, is found before by a join of key prefixes. So each
start and end becomes an event that carries what would be on top of the stack, urls are sorted among the events, and the
last event before a url (a running window) holds the innermost rule around it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerwell.llm.shared import free_name, partitions

#: Rule events in one bucket of the sweep, and url keys in one sweep group: both bound a task's sort.
EVENTS_PER_BUCKET = 10_000
KEYS_PER_GROUP = 500_000
MAX_BUCKETS = 1024

RULE_SCHEMA = "host string, path string, verdict string"


def url_host(url):
    """After the first `://` up to `/`, `?`, `#` or end, with A-Z lower-cased; empty for null or no `://`."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url):
    """What follows the host up to `?`, `#` or end; empty for null or no `://`."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _reversed_host(host):
    """`a.b.com` -> `com#b#a#`: one key is a prefix of another only at a label's end."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "#"), F.lit("#"))


def _bytes(key):
    return F.encode(key, "UTF-8")


def _prefix_end(key):
    """Bytes above all that start with key and below every other key that is above it: no UTF-8 text holds 0xFF."""
    return F.concat(_bytes(key), F.lit(b"\xff"))


def rule_events(rules: DataFrame) -> DataFrame:
    """(pos, top): the innermost active rule from `pos` on, as struct(key, size, host_size, rule, verdict) or null.

    `pos` is in bytes. Repeated rules count once; if they disagree, block wins. Rules without host or verdict, with a `#`, or
    with a path that doesn't start with a slash, fit nothing and are left out. The rule around another one is found by joining the
    prefixes of its key with the rules' keys, so no task sees all rules at once.
    """
    host = F.translate(F.coalesce("host", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.coalesce("path", F.lit(""))
    usable = F.col("verdict").isNotNull() & (F.length(host) > 0) & ((path == "") | F.startswith(path, F.lit("/"))) & ~F.contains(F.concat(host, path), F.lit("#"))
    rules = (
        rules.filter(usable)
        .select(F.concat(_reversed_host(host), path).alias("key"), F.length(_reversed_host(host)).alias("host_size"), F.concat(host, path).alias("rule"), "verdict")
        .groupBy("key", "host_size", "rule").agg(F.max("verdict").alias("verdict"))
    )
    top = F.struct("key", F.length("rule").alias("size"), "host_size", "rule", "verdict")
    rules = rules.select("key", top.alias("own"))
    shorter = rules.select("key", F.explode(F.sequence(F.lit(1), F.length("key"))).alias("n")).filter("n < length(key)").select(F.col("key").alias("inner"), F.expr("left(key, n)").alias("key"))
    around = shorter.join(rules, "key").groupBy("inner").agg(F.max_by("own", F.length("key")).alias("around"))
    both = rules.join(around, rules["key"] == around["inner"], "left")
    events = both.select(F.explode(F.array(
        F.struct(_bytes(F.col("key")).alias("pos"), F.lit(1).alias("rank"), F.length("key").alias("depth"), F.col("own").alias("top")),
        F.struct(_prefix_end(F.col("key")).alias("pos"), F.lit(0).alias("rank"), (-F.length("key")).alias("depth"), F.col("around").alias("top")),
    )).alias("e")).select("e.*")
    return events.select("pos", "rank", "depth", "top")


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule (host and path of the rule that decided, else null) and verdict.

    The longest fitting rule wins, by code points of host and path, then by host; without one the verdict is `default`.
    Null and broken urls have empty host and path and fit no rule. Repeated rows stay; an empty table gives an empty
    result; input columns called host, path, rule or verdict are replaced. Rows aren't joined back: a row travels once,
    with the first of its keys, and is put together again by its number within its input partition.
    """
    spark = pages.sparkSession
    made = ("host", "path", "rule", "verdict")
    row = pages.select([F.col(f"`{c}`") for c in pages.columns if c.lower() not in made or c == url])
    keep = row.columns
    events = rule_events(rules).withColumn("bucket", F.lit(0))
    keys_of = F.expr("transform(sequence(1, size(labels)), n -> struct(n as level, encode(concat(array_join(slice(labels, 1, n), '#'), '#', path), 'UTF-8') as key))")
    uid, link = free_name(row, "uid"), F.col(f"`{url}`")
    urls = (
        row.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.monotonically_increasing_id().alias(uid), url_host(link).alias("host"), url_path(link).alias("path"))
        .withColumn("labels", F.reverse(F.split("host", r"\.")))
        .select(uid, "row", "host", "path", F.explode(keys_of).alias("k"))
        .select(uid, F.when(F.col("k.level") == 1, F.struct("row", "host", "path")).alias("carried"), F.col("k.key").alias("pos"))
    )
    splitters, salts = _layout(spark, events, urls)
    bucket = _bucket_of(F.col("pos"), splitters)
    salt_of = F.element_at(F.array(*[F.lit(s) for s in salts]), F.col("bucket") + 1)
    sides = (
        urls.withColumn("bucket", bucket).withColumn("salt", F.pmod(F.xxhash64(uid), salt_of.cast("long")).cast("int"))
        .select("bucket", "salt", "pos", F.lit(2).alias("rank"), F.lit(0).alias("depth"), F.lit(None).cast(events.schema["top"].dataType).alias("top"), F.lit(False).alias("event"), uid, "carried"),
        events.withColumn("bucket", bucket).withColumn("salt", F.explode(F.sequence(F.lit(0), salt_of - 1)))
        .select("bucket", "salt", "pos", "rank", "depth", "top", F.lit(True).alias("event")),
    )
    swept = sides[0].unionByName(sides[1], allowMissingColumns=True)
    order = Window.partitionBy("bucket", "salt").orderBy("pos", "rank", "depth").rowsBetween(Window.unboundedPreceding, 0)
    innermost = F.last(F.when(F.col("event"), F.struct("top")), ignorenulls=True).over(order)["top"]
    hit = swept.withColumn("hit", innermost).filter(~F.col("event"))
    best = F.max(F.when(F.startswith("pos", _bytes(F.col("hit.key"))), F.struct("hit.size", "hit.host_size", "hit.rule", "hit.verdict")))
    judged = hit.groupBy(uid).agg(F.first("carried", ignorenulls=True).alias("carried"), best.alias("best"))
    return judged.select(*[F.col("carried.row")[c].alias(c) for c in keep], "carried.host", "carried.path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def _bucket_of(pos, splitters: list[bytes]):
    """Number of splitters at or below pos; bucket 0 has no event before it."""
    return reduce(lambda a, s: a + (pos >= F.lit(s)).cast("int"), splitters, F.lit(0)) if len(splitters) < 16 else F.size(F.filter(F.array(*[F.lit(s) for s in splitters]), lambda s: s <= pos))


def _layout(spark: SparkSession, events: DataFrame, urls: DataFrame) -> tuple[list[bytes], list[int]]:
    """Where the sweep is cut, at most MAX_BUCKETS event positions, and in how many salted groups each bucket is swept.

    Every cut is an event's position, so that a bucket starts with the event that tells its stack's top. A bucket with
    many urls (a hot host) is dealt to several groups, each with all of the bucket's events.
    """
    n = events.count()
    buckets = min(MAX_BUCKETS, n // EVENTS_PER_BUCKET + 1)
    splitters: list[bytes] = []
    if buckets > 1:
        tiles = events.select("pos").repartitionByRange(buckets, "pos").groupBy(F.spark_partition_id().alias("p")).agg(F.min("pos").alias("pos"))
        splitters = sorted({bytes(r["pos"]) for r in tiles.collect()})[1:]
    counts = dict(urls.groupBy(_bucket_of(F.col("pos"), splitters).alias("b")).count().collect())
    least = partitions(spark) if len(splitters) == 0 else 1
    return splitters, [max(least, counts.get(b, 0) // KEYS_PER_GROUP + 1) for b in range(len(splitters) + 1)]
