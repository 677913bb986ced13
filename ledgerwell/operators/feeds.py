"""News feeds: their addresses filled in for instruments, and which instrument an address was filled in for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwell.functions.storage import stored
from ledgerwell.operators import merging
from ledgerwell.operators import news as nw
from ledgerwell.sources import raw as rw

#: What a template may hold, and the column of targets that stands for it.
PLACEHOLDERS = {"{ticker}": "ticker", "{yahoo_ticker}": "symbol", "{isin}": "isin", "{name}": "name"}
#: Feeds that are broadcast at most, and the parts that targets are dealt into beyond that.
FEW_FEEDS, DEAL = 10_000, 64
#: Why a stored body isn't read again.
NO_FEED, NO_READER, NO_TARGET = "feed no longer present in the configuration", "no adapter for provider '", "url_template feed's URL matches no known instrument"


def quoted(value: Column) -> Column:
    """A value as part of an address: all but letters, digits and _.-~ as percent signs and bytes."""
    out = F.replace(F.replace(F.url_encode(value), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))
    return F.replace(out, F.lit("%7E"), F.lit("~"))


def filled(template: Column, target: dict[str, Column]) -> Column:
    """The template with a target's fields; null if it lacks one that the template names."""
    out = template
    for mark, name in PLACEHOLDERS.items():
        value = F.nullif(target[name], F.lit(""))
        out = F.when(~F.contains(template, F.lit(mark)), out).when(value.isNotNull(), F.replace(out, F.lit(mark), quoted(value)))
    return out


def _target() -> dict[str, Column]:
    return {name: F.col(name) for name in PLACEHOLDERS.values()}


def _with_all(feeds: DataFrame, targets: DataFrame) -> DataFrame:
    """Each feed with each target. Feeds are few, so they are broadcast once they are counted; more are dealt with a salt."""
    if feeds.count() <= FEW_FEEDS:
        return targets.withColumn("deal_", F.lit(0)).join(F.broadcast(feeds.withColumn("deal_", F.lit(0))), "deal_").drop("deal_")
    dealt = targets.withColumn("deal_", F.pmod(F.xxhash64("ticker", "position"), F.lit(DEAL)).cast("int"))
    return dealt.join(feeds.withColumn("deal_", F.explode(F.sequence(F.lit(0), F.lit(DEAL - 1)))), "deal_").drop("deal_")


def fixed(feeds: DataFrame, targets: DataFrame) -> DataFrame:
    """feeds with a fixed url, with `ticker` and `isin`: those it names if it names just one; a known isin wins."""
    one = lambda c: F.when(F.size(c) == 1, F.get(c, F.lit(0)))
    f = feeds.filter("url is not null").withColumn("one_", one("tickers"))
    named = targets.join(f.select(F.col("one_").alias("ticker")), "ticker", "left_semi")
    known = named.groupBy(F.col("ticker").alias("one_")).agg(F.min_by("isin", "position").alias("known_"), F.lit(True).alias("had_"))
    f = f.join(known, "one_", "left")
    return f.withColumn("isin", F.when(F.col("had_"), F.col("known_")).otherwise(one("isins"))).withColumnRenamed("one_", "ticker").drop("known_", "had_")


def plan(feeds: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests (feed_key, url, ticker, isin, trust) and notes (feed_key, ticker, note).

    feeds(feed_key, url, template, tickers, isins, trust), targets(ticker, symbol, isin, name, position). A feed with a
    template asks for the tickers that it names, else for all; each request is one row of the result, so that side of the
    join is the size of what is asked for.
    """
    direct = fixed(feeds, targets)
    several = direct.filter((F.size("tickers") > 1) | (F.size("isins") > 1)).select("feed_key", F.lit(None).cast("string").alias("ticker"), F.lit("several instruments with a fixed url: its items are market-wide").alias("note"))
    templated = feeds.filter("url is null and template is not null")
    named = templated.filter(F.size("tickers") > 0).withColumn("ticker", F.explode("tickers")).select("feed_key", "template", "trust", "ticker").distinct().join(targets, "ticker")
    to_all = _with_all(templated.filter("tickers is null or size(tickers) <= 0").select("feed_key", "template", "trust"), targets)
    asked = named.select("feed_key", "template", "trust", *targets.columns).unionByName(to_all.select("feed_key", "template", "trust", *targets.columns)).withColumn("url", filled(F.col("template"), _target()))
    requests = direct.select("feed_key", "url", "ticker", "isin", "trust").unionByName(asked.filter("url is not null").select("feed_key", "url", "ticker", "isin", "trust"))
    lacking = asked.filter("url is null").select("feed_key", "ticker", F.lit("needs a field that the instrument does not have").alias("note"))
    nothing = templated.join(asked.select("feed_key").distinct(), "feed_key", "left_anti").select("feed_key", F.lit(None).cast("string").alias("ticker"), F.lit("has no instruments to expand against").alias("note"))
    return requests, several.unionByName(lacking).unionByName(nothing)


def attributed(raw: DataFrame, feeds: DataFrame, targets: DataFrame, providers: tuple[str, ...]) -> DataFrame:
    """raw(raw_id, feed_key, url, ...) with provider, trust, ticker, isin and `skip`, why it can't be read again, else null.

    An address is traced back by the value that stands in it: the template's place is cut out of it and joined with that
    field of the targets, so neither all feeds nor all addresses meet all targets. Only templates with several places,
    whose values can't be told apart, are filled in for all targets. Of targets with one address the last position counts.
    """
    f = feeds.select("feed_key", "provider", "trust", F.col("url").alias("f_url"), "template", "tickers", "isins")
    rows = raw.join(f.withColumn("had_", F.lit(True)), "feed_key", "left")
    skip = F.when(F.col("had_").isNull(), NO_FEED).when(~F.coalesce(F.col("provider").isin(*providers), F.lit(False)), F.concat(F.lit(NO_READER), F.col("provider"), F.lit("'")))
    marks = F.filter(F.array(*[F.lit(m) for m in PLACEHOLDERS]), lambda m: F.contains(F.col("template"), m))
    mark = F.get(marks, F.lit(0))
    single = (F.size(marks) == 1) & (F.length("template") - F.length(F.replace(F.col("template"), mark, F.lit(""))) == F.length(mark))
    rows = rows.withColumns({"early_": skip, "mark_": F.when(F.col("f_url").isNull() & single, mark), "many_": F.col("f_url").isNull() & F.col("template").isNotNull() & ~single})
    before, after = F.expr("substring_index(template, mark_, 1)"), F.expr("substring_index(template, mark_, -1)")
    fits = F.startswith("url", before) & F.endswith("url", after) & (F.length("url") >= F.length(before) + F.length(after))
    rows = rows.withColumn("value_", F.when(fits, F.substr("url", F.length(before) + 1, F.length("url") - F.length(before) - F.length(after))))
    fields = targets.select("ticker", "isin", "position", F.explode(F.array(*[F.struct(F.lit(m).alias("mark_"), quoted(F.nullif(c, F.lit(""))).alias("value_")) for m, c in zip(PLACEHOLDERS, _target().values(), strict=True)])).alias("v"))
    by_value = fields.filter("v.value_ is not null").groupBy("v.mark_", "v.value_").agg(F.max_by(F.struct("ticker", "isin"), "position").alias("one_"))
    # the values of all targets are no small side, whatever their files' size says; rows without a value would meet in one task
    rows = rows.withColumn("value_", F.coalesce("value_", F.concat(F.lit("\0"), F.xxhash64("raw_id").cast("string"))))
    rows = rows.join(by_value.hint("merge"), ["mark_", "value_"], "left")
    index = _with_all(rows.filter("many_").select("feed_key", "template").distinct(), targets).withColumn("url", filled(F.col("template"), _target())).filter("url is not null")
    index = index.groupBy("feed_key", "url").agg(F.max_by(F.struct("ticker", "isin"), "position").alias("two_"))
    direct = fixed(feeds, targets).select("feed_key", F.struct("ticker", "isin").alias("three_"))
    rows = rows.join(index.hint("merge"), ["feed_key", "url"], "left").join(direct, "feed_key", "left")
    found = F.when(F.col("f_url").isNotNull(), F.col("three_")).when(F.col("template").isNull(), F.struct(F.lit(None).cast("string").alias("ticker"), F.lit(None).cast("string").alias("isin"))).otherwise(F.coalesce("one_", "two_"))
    skip = F.coalesce("early_", F.when(found.isNull(), NO_TARGET))
    return rows.select(*raw.columns, "provider", "trust", F.when(skip.isNull(), found["ticker"]).alias("ticker"), F.when(skip.isNull(), found["isin"]).alias("isin"), skip.alias("skip"))


#: Which reader takes a provider's bodies.
READERS = {"rss": rw.feed_items, "service": rw.news_items}


def reparsed(raw: DataFrame, feeds: DataFrame, targets: DataFrame, window_hours: int = 48, most: int = 2**31 - 1) -> tuple[DataFrame, DataFrame]:
    """Items of stored bodies raw(raw_id, feed_key, url, body), each story once, and counts (reason, n) of what was skipped.

    Items carry raw_id, feed_key, ticker, isin, headline, summary, address, canonical, title, ts and dedupe_key; whoever
    stores them inserts those whose key is new (tables.insert_new, news.new_items), so doing it again adds nothing.
    """
    known = stored(attributed(raw, feeds, targets, tuple(READERS)), "attributed")
    skipped = known.filter("skip is not null").groupBy(F.col("skip").alias("reason")).agg(F.count("*").alias("n"))
    usable = known.filter("skip is null").select("raw_id", "feed_key", "provider", "trust", "ticker", "isin", "body")
    items = None
    for provider, read in READERS.items():
        part = read(usable.filter(F.col("provider") == provider), "body", most).select("raw_id", "feed_key", "trust", "ticker", "isin", "headline", F.col("url").alias("address"), "published", "summary")
        items = part if items is None else items.unionByName(part)
    ts = nw.published_at(F.col("published"))
    items = items.withColumn("ts", ts).withColumns({"canonical": nw.canonical_url(F.col("address")), "title": nw.title_key(F.col("headline")), "dedupe_key": nw.dedupe_key(F.col("address"), F.col("ts"))})
    # a row is known by what is in it: reading the same bodies again gives the same ids
    items = items.withColumn("item_id", F.sha2(F.concat_ws("\n", F.col("raw_id").cast("string"), "headline", "address", "published", "summary"), 256)).dropDuplicates(["item_id"])
    items = stored(items, "items")
    kept = merging.merge_batch(items.select("item_id", "canonical", "title", "ts", "trust", "headline"), window_hours)
    return items.join(kept, "item_id", "left_semi").drop("item_id", "published", "trust"), skipped
