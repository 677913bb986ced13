"""News items: canonical addresses, title and dedupe keys, publication times, company terms, relevance and duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Query parameters that only track.
TRACKING = ("fbclid", "gclid", "igshid", "mc_cid", "mc_eid", "msclkid", "ref", "ref_src", "spm", "yclid")
#: Words of a name that tell nothing about the company.
SUFFIX_WORDS = (
    "inc", "corp", "corporation", "co", "company", "plc", "ltd", "limited", "holdings", "holding", "group", "sa", "nv", "ag", "se", "the", "&", "and", "class", "a", "b", "c", "adr", "ucits",
    "etf", "etc", "acc", "dist",
)
#: Words that don't name a company by themselves.
GENERIC_WORDS = (
    "achieve", "advanced", "american", "applied", "british", "capital", "chase", "digital", "energy", "financial", "first", "general", "global", "great", "health", "industries",
    "international", "life", "national", "new", "physical", "royal", "sciences", "solutions", "systems", "technologies", "technology", "united",
    "amundi", "invesco", "ishares", "spdr", "vanguard", "wisdomtree", "xtrackers",
)
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_PARTS = r"^\s*([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]*)(?::(\d*))?([^?#]*)(?:\?([^#]*))?"


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, no www., default port, tracking or blank parameters, fragment or closing slash; the
    other parameters sorted, as written. Null where there is no scheme."""
    part = lambda i: F.regexp_extract(url, _PARTS, i)
    host = F.regexp_replace(F.lower(part(2)), "^www[.]", "")
    port = F.when((part(3) == "") | part(3).isin("80", "443", "0"), "").otherwise(F.concat(F.lit(":"), part(3)))
    path = F.regexp_replace(part(4), "/+$", "")
    pairs = F.transform(F.split(part(5), "&"), lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.when(F.contains(p, F.lit("=")), F.regexp_replace(p, "^[^=]*=", "")).otherwise("").alias("v")))
    kept = F.array_sort(F.filter(pairs, lambda p: (p["v"] != "") & ~F.startswith(F.lower(p["k"]), F.lit("utm_")) & ~F.lower(p["k"]).isin(*TRACKING)))
    query = F.array_join(F.transform(kept, lambda p: F.concat(p["k"], F.lit("="), p["v"])), "&")
    return F.when(F.rlike(url, F.lit(_PARTS)), F.concat(F.lower(part(1)), F.lit("://"), host, port, F.when(path == "", "/").otherwise(path), F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def title_key(headline: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(headline), "[^0-9a-z]+", " "))


def published_at(text: Column) -> Column:
    """A timestamp from an RFC 3339 or RFC 822 text; without a zone it is UTC; null if it is neither."""
    t = F.trim(text)
    zone = r"(Z|z|[+-]\d{2}:?\d{2})?$"
    iso = F.when(F.rlike(t, F.lit(r"^\d{4}-\d{2}-\d{2}([Tt ]\d{2}:\d{2}(:\d{2}([.]\d{1,9})?)?" + zone[:-1] + ")?$")), F.when(F.rlike(t, F.lit(r"([Zz]|[+-]\d{2}:?\d{2})$")) & (F.length(t) > 10), F.upper(t)).otherwise(F.concat(t, F.when(F.length(t) == 10, "T00:00:00Z").otherwise("Z"))))
    mail = r"^(?:[A-Za-z]{3},? +)?(\d{1,2}) +([A-Za-z]{3})[a-z]* +(\d{4}) +(\d{2}:\d{2}(?::\d{2})?) *(GMT|UTC|UT|Z|[+-]\d{4})?$"
    part = lambda i: F.regexp_extract(t, mail, i)
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(part(2)))
    offset = F.when(F.rlike(part(5), F.lit(r"^[+-]")), F.concat(F.left(part(5), F.lit(3)), F.lit(":"), F.right(part(5), F.lit(2)))).otherwise("Z")
    rfc = F.when(F.rlike(t, F.lit(mail)) & (month > 0), F.concat(part(3), F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"), F.lpad(part(1), 2, "0"), F.lit("T"), part(4), F.when(F.length(part(4)) == 5, ":00").otherwise(""), offset))
    iso = F.regexp_replace(iso, r"([T ]\d{2}:\d{2})(?![\d:])", "$1:00")
    return F.coalesce(iso.try_cast("timestamp"), rfc.try_cast("timestamp"))


def iso_utc(ts: Column) -> Column:
    """A timestamp as 2024-01-31T08:30:00+00:00, with microseconds where there are any; empty for null."""
    utc = F.timestamp_micros(F.unix_micros(ts))
    micros = F.pmod(F.unix_micros(ts), F.lit(1_000_000))
    text = F.date_format(F.to_utc_timestamp(utc, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss")
    return F.coalesce(F.concat(text, F.when(micros > 0, F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))).otherwise(""), F.lit("+00:00")), F.lit(""))


def dedupe_key(url: Column, ts: Column) -> Column:
    return F.sha2(F.concat(canonical_url(url), F.lit("\n"), iso_utc(ts)), 256)


def company_terms(symbol: Column, name: Column, keywords: Column | None = None) -> Column:
    """struct(symbol, phrases): what names a company. Brackets and suffix words of the name don't count."""
    base = F.upper(F.trim(F.substring_index(symbol, ".", 1)))
    words = F.filter(F.regexp_extract_all(F.regexp_replace(F.coalesce(name, F.lit("")), r"\([^)]*\)", " "), F.lit(r"[A-Za-z0-9&.'-]+"), F.lit(0)), lambda w: ~F.lower(F.regexp_replace(w, r"[.]+$", "")).isin(*SUFFIX_WORDS))
    first, last, n = F.get(words, F.lit(0)), F.element_at(words, -1), F.size(words)
    telling = lambda w: (F.length(w) >= 4) & ~F.lower(w).isin(*GENERIC_WORDS)
    one = F.when(telling(first), first).when((n > 1) & telling(last), last)
    phrases = F.when(n > 0, F.array(F.array_join(words, " "), F.when(n > 1, F.array_join(F.slice(words, 1, 2), " ")), one)).otherwise(F.array().cast("array<string>"))
    if keywords is not None:
        phrases = F.concat(phrases, F.transform(F.coalesce(keywords, F.array().cast("array<string>")), lambda k: F.trim(k)))
    return F.struct(F.when(F.length(base) >= 2, base).alias("symbol"), F.array_distinct(F.filter(phrases, lambda p: p.isNotNull() & (p != ""))).alias("phrases"))


def _named(text: Column, terms: Column) -> Column:
    """The first of the terms that stands in the text as whole words: the symbol as written, phrases in any case."""
    quoted = lambda t: F.concat(F.lit(r"(?<![A-Za-z0-9])\Q"), t, F.lit(r"\E(?![A-Za-z0-9])"))
    symbol = F.when(F.rlike(text, quoted(terms["symbol"])), terms["symbol"])
    phrase = F.get(F.filter(terms["phrases"], lambda p: F.rlike(text, F.concat(F.lit("(?i)"), quoted(p)))), F.lit(0))
    return F.coalesce(symbol, phrase)


def classify(headline: Column, summary: Column, terms: Column) -> Column:
    """struct(relevance, matched): where a company is named; market without terms."""
    plain = F.regexp_replace(summary, "<[^>]+>", " ")
    top, below = _named(headline, terms), _named(plain, terms)
    relevance = F.when(terms.isNull(), "market").when(top.isNotNull(), "headline").when(below.isNotNull(), "summary").otherwise("unconfirmed")
    return F.struct(relevance.alias("relevance"), F.when(terms.isNotNull(), F.coalesce(top, below)).alias("matched"))


def new_items(batch: DataFrame, known: DataFrame, window_hours: int = 48) -> DataFrame:
    """Rows of batch that are in known neither by dedupe key, nor by canonical address, nor by title within the window.

    Both have (dedupe_key, canonical, title, ts). An item without a time matches every equal title. The title test joins
    on the title and on windows of time (its own and the two beside it), so equal titles of all times meet nowhere.
    """
    hours = window_hours * 3600
    slot = F.floor(F.unix_seconds("ts") / hours)
    rest = batch.join(known.select("dedupe_key").distinct(), "dedupe_key", "left_anti").join(known.select("canonical").distinct(), "canonical", "left_anti")
    titled = known.filter("title <> ''")
    undated = titled.groupBy("title").agg(F.max(F.col("ts").isNull()).alias("open"))
    rest = rest.join(undated, "title", "left").filter(~F.coalesce(F.col("open") | F.col("ts").isNull() & F.col("open").isNotNull(), F.lit(False)) | (F.col("title") == "")).drop("open")
    near = titled.filter("ts is not null").select(F.col("title").alias("k_title"), F.col("ts").alias("k_ts"), F.explode(F.array(slot - 1, slot, slot + 1)).alias("k_slot"))
    close = F.abs(F.unix_micros("ts") - F.unix_micros("k_ts")) <= hours * 1_000_000
    return rest.withColumn("slot_", slot).join(near, (F.col("title") == F.col("k_title")) & (F.col("slot_") == F.col("k_slot")) & close, "left_anti").drop("slot_")


def display_first(items: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first item of each key in list order."""
    return items.withColumn("rn_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("rn_ = 1").drop("rn_")


def listing_order() -> list[Column]:
    return [F.col("ts").desc_nulls_last(), F.col("headline"), F.col("news_id")]
