"""Queries over news and filings, with SQL for the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwell.operators import filings as fi
from ledgerwell.operators import news as nw
from ledgerwell.plans.adapters import sql_views, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
V = f"WITH {sql_views('v_news')}"
_MATCH = r"^\s*([A-Za-z][A-Za-z0-9+.-]*)://([^/?#:]*)(:[0-9]*)?([^?#]*)(\?[^#]*)?"
_TRACK = ", ".join(f"'{t}'" for t in nw.TRACKING)
_PART = f"regexp_extract(url, '{_MATCH}', {{0}})".format
_CANON = f"""lower({_PART(1)}) || '://' || regexp_replace(lower({_PART(2)}), '^www[.]', '') || CASE WHEN rtrim({_PART(4)}, '/') = '' THEN '/' ELSE rtrim({_PART(4)}, '/') END
 || coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(substr({_PART(5)}, 2), '&'), lambda p: contains(p, '=') AND NOT ends_with(p, '=') AND NOT starts_with(lower(p), 'utm_') AND lower(split_part(p, '=', 1)) NOT IN ({_TRACK}))), '&'), ''), '')"""
_TS = "try_strptime(published, ['%Y-%m-%dT%H:%M:%SZ', '%a, %d %b %Y %H:%M:%S GMT'])"
_KEYED = f"{V}, k AS (SELECT *, {_CANON} AS canonical, trim(regexp_replace(lower(headline), '[^0-9a-z]+', ' ', 'g')) AS title, {_TS} AS ts FROM v_news), kk AS (SELECT *, sha256(canonical || chr(10) || coalesce(strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00', '')) AS dedupe_key FROM k)"


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def _keyed(spark, sf_dir) -> DataFrame:
    n = view(spark, sf_dir, "v_news").withColumn("ts", nw.published_at(F.col("published")))
    return n.withColumn("canonical", nw.canonical_url(F.col("url"))).withColumn("title", nw.title_key(F.col("headline"))).withColumn("dedupe_key", nw.dedupe_key(F.col("url"), F.col("ts")))


@query("prj11_canonical_url", f"{_KEYED} SELECT news_id, canonical FROM kk")
def canonical_url(spark, sf_dir):
    return _keyed(spark, sf_dir).select("news_id", "canonical")


@query("prj12_title_key", f"{_KEYED} SELECT news_id, title FROM kk")
def title_key(spark, sf_dir):
    return _keyed(spark, sf_dir).select("news_id", "title")


@query("prj13_dedupe_key", f"{_KEYED} SELECT news_id, dedupe_key FROM kk")
def dedupe_key(spark, sf_dir):
    return _keyed(spark, sf_dir).select("news_id", "dedupe_key")


@query("prj14_published_at", f"{_KEYED} SELECT news_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS published_at FROM kk")
def published_at(spark, sf_dir):
    return _keyed(spark, sf_dir).select("news_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("published_at"))


@query("join14_new_items", f"{_KEYED}, a AS (SELECT * FROM kk WHERE news_id % 3 = 0), b AS (SELECT * FROM kk WHERE news_id % 3 <> 0) SELECT news_id FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.dedupe_key = a.dedupe_key OR b.canonical = a.canonical OR (b.title <> '' AND b.title = a.title AND (b.ts IS NULL OR a.ts IS NULL OR abs(epoch(b.ts) - epoch(a.ts)) <= 172800)))")
def new_items(spark, sf_dir):
    n = _keyed(spark, sf_dir)
    return nw.new_items(n.filter("news_id % 3 = 0"), n.filter("news_id % 3 <> 0")).select("news_id")


@query("win15_display_first", f"{_KEYED} SELECT company_id, title, news_id FROM kk QUALIFY row_number() OVER (PARTITION BY company_id, title ORDER BY ts DESC NULLS LAST, headline, news_id) = 1")
def display_first(spark, sf_dir):
    return nw.display_first(_keyed(spark, sf_dir), ["company_id", "title"], nw.listing_order()).select("company_id", "title", "news_id")


@query("flt06_news_listing", f"{_KEYED} SELECT news_id, company_id, headline FROM kk WHERE company_id = 7 ORDER BY ts DESC NULLS LAST, headline, news_id LIMIT 20")
def news_listing(spark, sf_dir):
    return _keyed(spark, sf_dir).filter("company_id = 7").orderBy(*nw.listing_order()).limit(20).select("news_id", "company_id", "headline")


_TERMS = r"""t AS (SELECT n_nationkey AS company_id, upper(substr(n_name, 1, 3)) AS symbol, list_filter(regexp_extract_all(n_name, '[A-Za-z0-9&.''-]+'), lambda w: lower(w) NOT IN ({0})) AS w FROM nation)
, terms AS (SELECT company_id, symbol, list_distinct(list_filter([array_to_string(w, ' '), CASE WHEN len(w) > 1 THEN w[1] || ' ' || w[2] END, CASE WHEN len(w[1]) >= 4 AND lower(w[1]) NOT IN ({1}) THEN w[1] WHEN len(w) > 1 AND len(w[-1]) >= 4 AND lower(w[-1]) NOT IN ({1}) THEN w[-1] END], lambda p: p IS NOT NULL)) AS p FROM t)""".format(", ".join(f"'{w}'" for w in nw.SUFFIX_WORDS), ", ".join(f"'{w}'" for w in nw.GENERIC_WORDS))


def _terms(spark, sf_dir) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    name = F.concat(F.col("n_name"), F.lit(" (common) Holdings Inc."))
    return n.select(F.col("n_nationkey").alias("company_id"), nw.company_terms(F.concat(F.substring("n_name", 1, 3), F.lit(".L")), name).alias("terms"))


@query("txt01_company_terms", f"WITH {_TERMS} SELECT company_id, symbol, array_to_string(list_sort(p), '|') AS phrases FROM terms")
def company_terms(spark, sf_dir):
    return _terms(spark, sf_dir).select("company_id", "terms.symbol", F.array_join(F.array_sort("terms.phrases"), "|").alias("phrases"))


def _classified(spark, sf_dir) -> DataFrame:
    n = _keyed(spark, sf_dir).join(_terms(spark, sf_dir), "company_id", "left").withColumn("terms", F.when(F.col("company_id") != 24, F.col("terms")))
    return n.withColumn("c", nw.classify(F.col("headline"), F.col("summary"), F.col("terms")))


_FOUND = "regexp_matches({0}, '(^|[^A-Za-z0-9])' || symbol || '($|[^A-Za-z0-9])') OR len(list_filter(p, lambda x: regexp_matches({0}, '(?i)(^|[^A-Za-z0-9])' || x || '($|[^A-Za-z0-9])'))) > 0".format
_CLASS = f"{_KEYED}, {_TERMS}, cl AS (SELECT kk.*, CASE WHEN company_id = 24 THEN 'market' WHEN {_FOUND('headline')} THEN 'headline' WHEN {_FOUND(chr(40) + 'regexp_replace(summary, $$<[^>]+>$$, $$ $$, $$g$$)' + chr(41))} THEN 'summary' ELSE 'unconfirmed' END AS relevance FROM kk JOIN terms USING (company_id))".replace("$$", "'")


@query("txt02_relevance", f"{_CLASS} SELECT news_id, relevance FROM cl")
def relevance(spark, sf_dir):
    return _classified(spark, sf_dir).select("news_id", "c.relevance")


@query("txt03_ranked_news", f"{_CLASS}, d AS (SELECT * FROM cl QUALIFY row_number() OVER (PARTITION BY company_id, title ORDER BY ts DESC NULLS LAST, headline, news_id) = 1) SELECT news_id, company_id, relevance, CAST(row_number() OVER (ORDER BY ts DESC NULLS LAST, headline, news_id) AS INTEGER) AS rank FROM d WHERE relevance <> 'unconfirmed' QUALIFY rank <= 50")
def ranked_news(spark, sf_dir):
    from pyspark.sql import Window

    first = nw.display_first(_classified(spark, sf_dir), ["company_id", "title"], nw.listing_order()).filter("c.relevance <> 'unconfirmed'")
    top = first.orderBy(*nw.listing_order()).limit(50)  # the list that is shown
    return top.select("news_id", "company_id", "c.relevance", F.row_number().over(Window.orderBy(*nw.listing_order())).alias("rank"))


_SIC = "CASE " + " ".join(f"WHEN sic BETWEEN {a} AND {b} THEN '{s}'" for a, b, s in fi.SIC_SECTORS) + " END"


@query("prj08_sic_sector", f"SELECT c_custkey, {_SIC} AS sector FROM (SELECT c_custkey, (c_custkey * 7) % 10000 AS sic FROM customer)")
def sic_sector(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", fi.sic_sector(F.col("c_custkey") * 7 % 10000).alias("sector"))


@query("prj09_normalised_company", "SELECT p_partkey, array_to_string(list_filter(string_split(trim(regexp_replace(lower(concat('The ', p_name, ', Inc. (New)')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w NOT IN (" + ", ".join(f"'{w}'" for w in fi.NAME_NOISE) + ")), ' ') AS name FROM part")
def normalised_company(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select("p_partkey", fi.normalised_company(F.concat(F.lit("The "), "p_name", F.lit(", Inc. (New)"))).alias("name"))


@query("prj10_cusip", "SELECT p_partkey, CASE WHEN length(i) = 12 AND substr(i, 1, 2) IN ('US', 'CA') THEN substr(i, 3, 9) END AS cusip FROM (SELECT p_partkey, concat(CASE p_partkey % 4 WHEN 0 THEN 'US' WHEN 1 THEN 'CA' WHEN 2 THEN 'DE' ELSE 'U' END, lpad(CAST(p_partkey AS VARCHAR), 9, '0'), CAST(p_partkey % 10 AS VARCHAR)) AS i FROM part)")
def cusip(spark, sf_dir):
    country = F.expr("CASE p_partkey % 4 WHEN 0 THEN 'US' WHEN 1 THEN 'CA' WHEN 2 THEN 'DE' ELSE 'U' END")
    isin = F.concat(country, F.lpad(F.col("p_partkey").cast("string"), 9, "0"), (F.col("p_partkey") % 10).cast("string"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", fi.cusip(isin).alias("cusip"))


@query("join25_sectors_by_name", f"WITH f AS (SELECT lower(n_name) AS name, min((n_nationkey * 371) % 10000) AS sic FROM nation GROUP BY ALL) SELECT s_suppkey, {_SIC} AS sector FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN f ON f.name = lower(n_name)")
def sectors_by_name(spark, sf_dir):
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    filers = nation.select(fi.normalised_company(F.concat("n_name", F.lit(" PLC"))).alias("name"), (F.col("n_nationkey") * 371 % 10000).alias("sic")).groupBy("name").agg(F.min("sic").alias("sic"))
    held = spark.read.parquet(f"{sf_dir}/supplier.parquet").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", fi.normalised_company(F.concat("n_name", F.lit(" Holdings, Inc."))).alias("name"))
    return held.join(filers, "name").select("s_suppkey", fi.sic_sector(F.col("sic")).alias("sector"))
