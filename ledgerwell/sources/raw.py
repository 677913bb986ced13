"""Files and raw texts as typed rows: exports, calendars, rates, declared dividends, company facts and news feeds."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What stands for no number, and the columns that an export must have (one of the times).
NO_NUMBER = ("", "none", "null", "-")
EXPORT_COLUMNS, EXPORT_TIMES = ("Action", "ID"), ("Time (UTC)", "Time")
FACT = "struct<start:string,`end`:string,val:double,filed:string,form:string>"


def number(text: Column) -> Column:
    """A decimal, null where the text is none."""
    t = F.trim(text)
    return F.when(~F.lower(t).isin(*NO_NUMBER), t).try_cast("decimal(28,10)")


def _text(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, action, ts, total, currency, merchant_name, merchant_category, notes) of the cash rows of account exports.

    Rows with a ticker are trades and dividends, which come from elsewhere; rows without an id, action or time are left
    out; a total that is no number is null. A file without the needed columns is refused.
    """
    raw = _csv(spark, path)
    time = next((c for c in EXPORT_TIMES if c in raw.columns), None)
    if time is None or any(c not in raw.columns for c in EXPORT_COLUMNS):
        raise ValueError("no account export: it has no action, id or time column")
    col = lambda c: _text(F.col(f"`{c}`")) if c in raw.columns else F.lit(None).cast("string")
    rows = raw.select(
        col("ID").alias("row_id"), col("Action").alias("action"), col(time).try_cast("timestamp").alias("ts"), number(col("Total")).alias("total"), col("Currency (Total)").alias("currency"),
        col("Merchant name").alias("merchant_name"), col("Merchant category").alias("merchant_category"), col("Notes").alias("notes"), col("Ticker").alias("ticker"),
    )
    return rows.filter("row_id is not null and action is not null and ts is not null and ticker is null").drop("ticker")


def read_earnings(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, report_date, fiscal_date_ending, estimate_eps, currency_code, time_of_day) of an earnings calendar."""
    raw = _csv(spark, path)
    day = lambda c: F.left(F.trim(F.col(c)), F.lit(10)).try_cast("date")
    rows = raw.select(_text(F.col("symbol")).alias("symbol"), day("reportDate").alias("report_date"), day("fiscalDateEnding").alias("fiscal_date_ending"), number(F.col("estimate")).alias("estimate_eps"), _text(F.col("currency")).alias("currency_code"), F.lower(_text(F.col("timeOfTheDay"))).alias("time_of_day"))
    return rows.filter("symbol is not null and report_date is not null")


def read_rates(spark: SparkSession, path: str) -> DataFrame:
    """(currency, rate_date, eur_per_unit) from a file of units per euro: inverted; what is zero or no number is dropped."""
    raw = _csv(spark, path)
    quoted = number(F.col("OBS_VALUE")).cast("double")
    rows = raw.select(F.upper(F.trim(F.col("CURRENCY"))).alias("currency"), F.trim(F.col("TIME_PERIOD")).try_cast("date").alias("rate_date"), (1 / F.nullif(quoted, F.lit(0.0))).alias("eur_per_unit"))
    return rows.dropna()


def declared_dividends(raw: DataFrame, body: str) -> DataFrame:
    """raw with ex_date, paid_on and amount of each dividend in a JSON body; those without a day or with no amount are left out."""
    items = F.from_json(F.get_json_object(F.col(body), "$.data"), "array<struct<ex_dividend_date:string,payment_date:string,amount:string>>")
    rows = raw.withColumn("item_", F.explode(items)).select(*[c for c in raw.columns if c != body], F.col("item_.ex_dividend_date").try_cast("date").alias("ex_date"), F.col("item_.payment_date").try_cast("date").alias("paid_on"), number(F.col("item_.amount")).alias("amount"))
    return rows.filter("ex_date is not null and amount > 0")


def company_facts(raw: DataFrame, body: str, concepts: tuple[str, ...], unit: str = "USD") -> DataFrame:
    """raw with concept, start, end, val, filed: of the alternative concepts the one reported last, one fact a span, as filed last."""
    facts = F.from_json(F.col(body), f"struct<facts:struct<`us-gaap`:map<string,struct<units:map<string,array<{FACT}>>>>>>")["facts"]["us-gaap"]
    keys = [c for c in raw.columns if c != body]
    rows = raw.withColumn("f_", facts).select(*keys, F.explode(F.array(*[F.struct(F.lit(i).alias("order_"), F.lit(c).alias("concept"), F.element_at(F.element_at("f_", c)["units"], unit).alias("rows")) for i, c in enumerate(concepts)])).alias("c"))
    rows = rows.select(*keys, "c.order_", "c.concept", F.explode("c.rows").alias("x")).select(*keys, "order_", "concept", *[F.col(f"x.{d}").try_cast("date").alias(d) for d in ("start", "end", "filed")], F.col("x.val").alias("val"))
    rows = rows.filter("`end` is not null and val is not null and filed is not null")
    one = rows.groupBy(*keys, "order_", "concept", "start", "end").agg(F.max(F.struct("filed", "val")).alias("l"))
    latest = one.groupBy(*keys).agg(F.max(F.struct("end", (-F.col("order_")).alias("o"), "concept")).alias("m")).select(*keys, F.col("m.concept").alias("concept"))
    return one.join(latest, [*keys, "concept"]).select(*keys, "concept", "start", "end", "l.val", "l.filed")


def feed_items(raw: DataFrame, body: str, most: int = 2**31 - 1) -> DataFrame:
    """raw with headline, url, published and summary of the items of an RSS or Atom body: those with a headline and an http link.

    A body that is no XML has no items. `most` items of a body are taken, in its order, if a feed is to have a cap.
    """
    inside = F.regexp_extract_all(F.regexp_replace(F.col(body), r"(?s)<!DOCTYPE[^>\[]*(\[.*?\])?[^>]*>|<!--.*?-->", ""), F.lit(r"(?s)<(item|entry)(?:\s[^>]*)?>(.*?)</\1>"), F.lit(2))
    tag = lambda x, names: F.regexp_extract(x, rf"(?s)<(?:{names})(?:\s[^>]*)?>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</(?:{names})>", 1)
    plain = lambda t: F.nullif(F.trim(F.replace(F.replace(F.replace(F.replace(t, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&"))), F.lit(""))
    link = lambda x: F.coalesce(plain(tag(x, "link")), plain(F.regexp_extract(x, r"<link[^>]*\shref=[\"']([^\"']+)", 1)))
    items = F.transform(inside, lambda x: F.struct(plain(tag(x, "title")).alias("headline"), link(x).alias("url"), plain(tag(x, "pubDate|published|updated")).alias("published"), plain(tag(x, "description|summary")).alias("summary")))
    usable = F.slice(F.filter(items, lambda i: i["headline"].isNotNull() & F.rlike(i["url"], F.lit("^https?://"))), 1, most)
    return raw.withColumn("i_", F.explode(usable)).select(*[c for c in raw.columns if c != body], "i_.*")


def news_items(raw: DataFrame, body: str, most: int = 2**31 - 1) -> DataFrame:
    """raw with headline, url, published and summary of the items of a JSON body ({"data": [...]}) of a news service.

    Items without a title or an http address are left out, after `most` items of a body were taken in its order; the
    summary is the description, else the snippet. A body that is no such JSON has no items.
    """
    items = F.from_json(F.get_json_object(F.col(body), "$.data"), "array<struct<title:string,url:string,description:string,snippet:string,published_at:string>>")
    rows = raw.withColumn("i_", F.explode(F.slice(items, 1, most))).filter(F.col("i_.title").isNotNull() & F.rlike(F.col("i_.url"), F.lit("(?i)^https?:")))
    summary = F.coalesce(F.nullif(F.col("i_.description"), F.lit("")), F.col("i_.snippet"))
    return rows.select(*[c for c in raw.columns if c != body], F.trim("i_.title").alias("headline"), "i_.url", F.col("i_.published_at").alias("published"), _text(summary).alias("summary"))


#: What a factor file writes for no value, and its names of the factors.
NO_FACTOR = ("-99.99", "-999")
FACTORS = {"Mkt-RF": "mkt_rf", "SMB": "smb", "HML": "hml", "RMW": "rmw", "CMA": "cma", "RF": "risk_free", "Mom": "mom"}


@F.pandas_udf(T.StringType())
def _unzipped(bodies: pd.Series) -> pd.Series:
    """The first file of each archive as text; null for what is no archive or holds none."""

    def text(body):
        try:
            with zipfile.ZipFile(io.BytesIO(body)) as archive:
                return archive.read(archive.namelist()[0]).decode("latin-1")
        except (zipfile.BadZipFile, IndexError, TypeError):
            return None

    return bodies.map(text)


def factor_rows(raw: DataFrame, body: str) -> DataFrame:
    """raw with as_of, factor and value (a fraction) of zipped daily factor files.

    The table starts below the first row with an empty first cell and names after it, and ends at the first row after its
    data that has no day. Values that stand for none are left out; a day given twice counts as given last. An archive
    that can't be read, or a text without such a header, stops the job.
    """
    keys = [c for c in raw.columns if c != body]
    lines = F.transform(F.split(F.col("t_"), r"\r?\n"), lambda x: F.transform(F.split(x, ","), lambda c: F.trim(c)))
    is_header = lambda c: (F.size(c) > 1) & (F.get(c, F.lit(0)) == "") & F.exists(F.slice(c, 2, F.size(c)), lambda x: x != "")
    is_day = lambda c: F.rlike(F.get(c, F.lit(0)), F.lit("^[0-9]{8}$"))
    rows = raw.withColumn("t_", _unzipped(F.col(body))).withColumn("l_", lines).withColumn("at_", F.array_position(F.transform("l_", is_header), True))
    rows = rows.withColumn("at_", F.when(F.col("at_") > 0, F.col("at_").cast("int")).otherwise(F.raise_error(F.lit("no factor file: it has no row of names")).cast("int")))
    rows = rows.withColumn("h_", F.element_at("l_", F.col("at_"))).withColumn("d_", F.slice("l_", F.col("at_") + 1, F.size("l_")))
    first = F.array_position(F.transform("d_", is_day), True).cast("int")
    rows = rows.withColumn("d_", F.when(first > 0, F.slice("d_", F.greatest(first, F.lit(1)), F.size("d_"))).otherwise(F.slice("d_", 1, 0)))
    stop = F.array_position(F.transform("d_", is_day), False).cast("int")
    rows = rows.select(*keys, "h_", F.posexplode(F.when(stop > 0, F.slice("d_", 1, stop - 1)).otherwise(F.col("d_"))).alias("p_", "c_"))
    days = rows.withColumn("as_of", F.to_date(F.get("c_", F.lit(0)), "yyyyMMdd")).groupBy(*keys, "as_of").agg(F.max_by(F.struct("h_", "c_"), "p_").alias("r_"))
    tail = lambda c: F.slice(F.col(c), 2, F.size(c))
    cells = days.select(*keys, "as_of", F.explode(F.arrays_zip(tail("r_.h_").alias("factor"), tail("r_.c_").alias("cell"))).alias("x"))
    value = number(F.col("x.cell"))
    return cells.filter(F.col("x.factor").isNotNull() & value.isNotNull() & ~value.isin(*[F.lit(v).cast("decimal(28,10)") for v in NO_FACTOR])).select(*keys, "as_of", F.col("x.factor").alias("factor"), (value.cast("double") / 100).alias("value"))


def factor_days(five: DataFrame, momentum: DataFrame) -> DataFrame:
    """(as_of, mkt_rf, smb, hml, rmw, cma, mom, risk_free) of the days that have every one of them; none is filled in."""
    rows = five.filter("factor <> 'Mom'").select("as_of", "factor", "value").unionByName(momentum.filter("factor = 'Mom'").select("as_of", "factor", "value"))
    wide = rows.groupBy("as_of").agg(*[F.max(F.when(F.col("factor") == name, F.col("value"))).alias(alias) for name, alias in FACTORS.items()])
    return wide.dropna()


_HOLDING = "struct<name:string,title:string,lei:string,cusip:string,pctVal:string,assetCat:string,invCountry:string,identifiers:struct<isin:struct<_value:string>>>"
_REPORT = f"struct<formData:struct<genInfo:struct<repPdDate:string>,invstOrSecs:struct<invstOrSec:array<{_HOLDING}>>>>"
NO_CUSIP = "000000000"
TOP_HOLDINGS = 300


def _report_rows(raw: DataFrame, body: str) -> tuple[DataFrame, list[str]]:
    keys = [c for c in raw.columns if c != body]
    rows = raw.select(*keys, F.from_xml(F.col(body), _REPORT, {"ignoreNamespace": "true"}).alias("r_"))
    rows = rows.select(*keys, F.col("r_.formData.genInfo.repPdDate").try_cast("date").alias("report_date"), F.posexplode("r_.formData.invstOrSecs.invstOrSec").alias("p_", "x"))
    cell = lambda c: _text(F.col(f"x.{c}"))
    cusip = F.when(cell("cusip") != NO_CUSIP, cell("cusip"))
    pct = F.coalesce(F.trim("x.pctVal").try_cast("double"), F.lit(0.0))
    rows = rows.select(*keys, "report_date", "p_", F.coalesce(cell("lei"), cusip, cell("name"), F.lit("")).alias("issuer"), F.coalesce(cell("name"), cell("title")).alias("name"), cusip.alias("cusip"), F.col("x.identifiers.isin._value").alias("isin"), F.coalesce(cell("invCountry"), F.lit("Other")).alias("country"), cell("assetCat").alias("category"), pct.alias("pct"))
    return rows, keys


def fund_holdings(raw: DataFrame, body: str, keep: int = TOP_HOLDINGS) -> DataFrame:
    """raw with report_date, rank, issuer, name, cusip, isin, country, category and pct of a fund report's largest holdings.

    Holdings of one issuer (its LEI, else its CUSIP, else its name) are one row as first listed, with their shares summed;
    the `keep` largest stay, equal shares in the report's order. A body that is no such XML has none.
    """
    rows, keys = _report_rows(raw, body)
    first = F.min_by(F.struct("name", "cusip", "isin", "country", "category", "report_date"), "p_")
    merged = rows.groupBy(*keys, "issuer").agg(F.sum("pct").alias("pct"), F.min("p_").alias("p_"), first.alias("f"))
    ranked = merged.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("pct"), "p_"))).filter(F.col("rank") <= keep)
    return ranked.select(*keys, "f.report_date", "rank", "issuer", "f.name", "f.cusip", "f.isin", "f.country", "f.category", "pct")


def fund_countries(raw: DataFrame, body: str) -> DataFrame:
    """raw with country, pct and holdings: every holding of a fund report counts, also those below the largest."""
    rows, keys = _report_rows(raw, body)
    return rows.groupBy(*keys, "country").agg(F.sum("pct").alias("pct"), F.count("*").alias("holdings"))
