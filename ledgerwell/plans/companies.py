"""Queries over company figures, exposure and fund reports, with SQL for the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwell.operators import companies as co
from ledgerwell.plans.adapters import sql_views, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
KEYS = ["company", "metric"]
TODAY = "1998-06-30"


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def _facts(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "v_facts").withColumnsRenamed({"f_start": "start", "f_end": "end"})


# The same rules as correlated subqueries: for each target the fact filed last, then the earliest.
_NEAR = "(SELECT struct_pack(s := f_start, e := f_end, v := val) FROM {0} n WHERE n.company = {1}.company AND n.metric = {1}.metric AND abs(n.f_end - ({2})) <= {4} AND abs((n.f_end - n.f_start) - ({3})) <= {4} ORDER BY filed DESC, f_end, f_start LIMIT 1)".format
_YEAR = f"""b AS (SELECT company, metric, max(f_end) AS latest, max(f_end) FILTER (f_end - f_start BETWEEN 350 AND 380) AS fy_end, arg_max(val, f_end) FILTER (f_end - f_start BETWEEN 350 AND 380) AS fy FROM v_facts GROUP BY ALL),
cur AS (SELECT company, metric, latest, f_end - f_start AS n, val FROM v_facts JOIN b USING (company, metric) WHERE fy_end < latest AND f_end = latest AND abs(f_start - fy_end - 1) <= 4 QUALIFY row_number() OVER (PARTITION BY company, metric ORDER BY n DESC) = 1),
roll AS (SELECT company, metric, val - {_NEAR('v_facts', 'cur', 'cur.latest - 364', 'cur.n', 12)}.v AS gain FROM cur),
four AS (SELECT company, metric, sum(val) AS v, max(f_end) AS e FROM (SELECT * FROM v_facts WHERE f_end - f_start BETWEEN 80 AND 100 QUALIFY row_number() OVER (PARTITION BY company, metric ORDER BY f_end DESC) <= 4) GROUP BY ALL HAVING count(*) = 4 AND max(f_end) - min(f_end) <= 290),
ttm AS (SELECT company, metric, CASE WHEN fy_end >= latest THEN fy WHEN gain IS NOT NULL THEN fy + gain WHEN e IS NOT NULL THEN v ELSE fy END AS ttm, CASE WHEN fy_end >= latest THEN fy_end WHEN gain IS NOT NULL THEN latest WHEN e IS NOT NULL THEN e ELSE fy_end END AS ttm_end FROM b LEFT JOIN roll USING (company, metric) LEFT JOIN four USING (company, metric) WHERE ttm_end IS NOT NULL)"""
_QUARTER = f"""y AS (SELECT * FROM v_facts WHERE f_end - f_start BETWEEN 350 AND 380), y9 AS (SELECT *, {_NEAR('v_facts', 'y', 'y.f_end - 91', 'y.f_end - y.f_start - 91', 15)} AS nine FROM y),
qs AS (SELECT company, metric, f_start, f_end, val, filed FROM v_facts WHERE f_end - f_start BETWEEN 80 AND 100),
every AS (SELECT * FROM qs UNION ALL SELECT company, metric, nine.e + 1, f_end, val - nine.v, filed FROM y9 WHERE nine.s = f_start AND NOT EXISTS (SELECT 1 FROM qs WHERE qs.company = y9.company AND qs.metric = y9.metric AND qs.f_end = y9.f_end)),
l AS (SELECT company, metric, max(f_end) AS quarter_end, arg_max(val, f_end) AS quarter, arg_max(f_end - f_start, f_end) AS n FROM every GROUP BY ALL),
q AS (SELECT company, metric, quarter, quarter_end, {_NEAR('every', 'l', 'l.quarter_end - 364', 'l.n', 15)}.v AS before FROM l)"""
_BASE = f"WITH {sql_views('v_facts')}, "


@query("agg36_trailing_year", f"{_BASE}{_YEAR} SELECT company, metric, round(ttm, 4) AS ttm, ttm_end FROM ttm")
def trailing_year(spark, sf_dir):
    return co.trailing_year(_facts(spark, sf_dir), KEYS).withColumn("ttm", F.round("ttm", 4))


@query("agg36_latest_quarter", f"{_BASE}{_QUARTER} SELECT company, metric, round(quarter, 4) AS quarter, quarter_end, round(before, 4) AS before FROM q")
def latest_quarter(spark, sf_dir):
    q = co.latest_quarter(_facts(spark, sf_dir), KEYS)
    return q.select(*KEYS, F.round("quarter", 4).alias("quarter"), "quarter_end", F.round("before", 4).alias("before"))


@query("join18_year_before", f"{_BASE}t AS (SELECT * FROM v_facts WHERE f_end - f_start BETWEEN 80 AND 100), n AS (SELECT company, metric, f_end, {_NEAR('v_facts', 't', 't.f_end - 364', 't.f_end - t.f_start', 12)} AS n FROM t) SELECT company, metric, f_end AS quarter_end, n.e AS near_end, n.v AS val FROM n WHERE n IS NOT NULL")
def year_before(spark, sf_dir):
    facts = _facts(spark, sf_dir)
    targets = facts.withColumn("aim_days", F.datediff("end", "start")).filter("aim_days between 80 and 100").select(*KEYS, F.col("end").alias("quarter_end"), F.date_sub("end", 364).alias("aim"), "aim_days")
    return co.nearest(targets, facts, KEYS, 12).select(*KEYS, "quarter_end", F.col("near.end").alias("near_end"), F.col("near.val").alias("val"))


@query(
    "agg37_company_figures",
    f"""{_BASE}{_YEAR}, {_QUARTER}, j AS (SELECT *, max(greatest(ttm_end, quarter_end)) OVER (PARTITION BY company) AS newest FROM ttm FULL JOIN q USING (company, metric)),
f AS (SELECT company, metric, CASE WHEN newest - ttm_end <= 550 THEN ttm END AS ttm, CASE WHEN newest - quarter_end <= 550 THEN quarter END AS quarter,
 CASE WHEN newest - quarter_end <= 550 AND coalesce(newest - ttm_end, 0) <= 550 AND before <> 0 THEN (quarter - before) / abs(before) END AS growth FROM j)
SELECT f.company, f.metric, round(f.ttm, 4) AS ttm, round(f.quarter, 4) AS quarter, round(f.growth, 6) AS growth, round(CASE WHEN f.metric IN ('net_income', 'operating_income') AND r.ttm > 0 THEN f.ttm / r.ttm END, 6) AS margin
FROM f LEFT JOIN f r ON r.company = f.company AND r.metric = 'revenue' WHERE f.ttm IS NOT NULL OR f.quarter IS NOT NULL""",
)
def company_figures(spark, sf_dir):
    f = co.figures(_facts(spark, sf_dir), "company")
    return f.select(*KEYS, F.round("ttm", 4).alias("ttm"), F.round("quarter", 4).alias("quarter"), F.round("growth", 6).alias("growth"), F.round("margin", 6).alias("margin"))


@query(
    "agg38_company_derived",
    f"""WITH {sql_views('v_prices', 'v_instruments')}, k AS (SELECT p_brand AS ticker, CAST(sum(p_size) AS DOUBLE) AS shares, CAST(count(*) % 4 AS DOUBLE) AS eps FROM part GROUP BY ALL),
p AS (SELECT ticker, arg_max(close_price, price_date) AS c, max(price_date) AS price_date, max(close_price) AS hi, min(close_price) AS lo FROM v_prices WHERE price_date BETWEEN DATE '{TODAY}' - 372 AND DATE '{TODAY}' GROUP BY ALL)
SELECT ticker, CAST(c AS DOUBLE) AS price, price_date, CAST(hi AS DOUBLE) AS high_52w, CAST(lo AS DOUBLE) AS low_52w, CASE WHEN currency = 'USD' THEN round(CAST(c AS DOUBLE) * shares, 4) END AS market_cap, CASE WHEN currency = 'USD' AND eps > 0 THEN round(CAST(c AS DOUBLE) / eps, 6) END AS pe
FROM k JOIN v_instruments USING (ticker) LEFT JOIN p USING (ticker)""",
)
def company_derived(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet").groupBy(F.col("p_brand").alias("ticker")).agg(F.sum("p_size").cast("double").alias("shares"), (F.count("*") % 4).cast("double").alias("eps"))
    known = part.join(view(spark, sf_dir, "v_instruments"), "ticker")
    d = co.derived(view(spark, sf_dir, "v_prices"), known, F.lit(TODAY).cast("date"))
    return d.select("ticker", "price", "price_date", *[F.col(c).cast("double").alias(c) for c in ("high_52w", "low_52w")], F.round("market_cap", 4).alias("market_cap"), F.round("pe", 6).alias("pe"))


@query("agg37_shares_outstanding", "WITH d AS (SELECT o_custkey % 50 AS company, CAST(o_orderdate AS DATE) AS d, sum(o_totalprice) AS v FROM orders GROUP BY ALL) SELECT company, round(arg_max(v, d), 4) AS shares, max(d) AS shares_as_of FROM d GROUP BY ALL")
def shares_outstanding(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_custkey") % 50).alias("company"), F.col("o_orderdate").cast("date").alias("end"), F.col("o_totalprice").alias("val"))
    return co.shares_outstanding(o, "company").withColumn("shares", F.round("shares", 4))


_EXPOSED = f"""WITH {sql_views('v_stakes', 'v_fund_rows')}, h AS (SELECT fund, key, name, sum(pct) AS pct, min(sector) AS sector FROM v_fund_rows GROUP BY ALL), n AS (SELECT fund, country, sum(pct) AS pct FROM v_fund_rows GROUP BY ALL),
pos AS (SELECT * FROM v_stakes WHERE value > 0), lo AS (SELECT DISTINCT fund FROM h), seen AS (SELECT * FROM pos WHERE asset IS NULL AND fund IN (SELECT fund FROM lo)), uns AS (SELECT * FROM pos WHERE asset IS NULL AND fund IS NOT NULL AND fund NOT IN (SELECT fund FROM lo)), dir AS (SELECT * FROM pos WHERE asset IS NULL AND fund IS NULL),
parts AS (SELECT account_id, 'asset:' || asset AS key, NULL AS via, value AS eur, 'Commodities' AS sector, false AS other FROM pos WHERE asset IS NOT NULL
 UNION ALL SELECT account_id, 'fund:' || ticker, NULL, value, 'Unclassified', true FROM uns
 UNION ALL SELECT account_id, h.key, ticker, value * pct / 100, coalesce(h.sector, 'Unclassified'), false FROM seen JOIN h ON h.fund = seen.fund WHERE pct > 0
 UNION ALL SELECT account_id, 'other:' || ticker, ticker, value * (1 - c), 'Unclassified', true FROM seen JOIN (SELECT fund, sum(pct) / 100 AS c FROM h WHERE pct > 0 GROUP BY ALL) x ON x.fund = seen.fund WHERE c < 1
 UNION ALL SELECT account_id, CASE WHEN substr(isin, 1, 2) IN ('US', 'CA') THEN substr(isin, 3, 9) ELSE ticker END, NULL, value, 'Unclassified', false FROM dir
 UNION ALL SELECT DISTINCT account_id, 'cash', NULL, 5000.0, 'Cash', true FROM v_stakes)"""


def _exposure(spark, sf_dir) -> co.Exposure:
    rows, stakes = view(spark, sf_dir, "v_fund_rows"), view(spark, sf_dir, "v_stakes")
    holdings = rows.groupBy("fund", "key", "name").agg(F.sum("pct").alias("pct"), F.min("sector").alias("sector"))
    countries = rows.groupBy("fund", "country").agg(F.sum("pct").alias("pct"))
    facts = spark.createDataFrame([], "ticker string, country string, sector string")
    return co.exposure(stakes, facts, holdings, countries, stakes.select("account_id").distinct().withColumn("eur", F.lit(5000.0)))


@query("agg39_exposed_companies", f"{_EXPOSED}, k AS (SELECT account_id, key, sum(CASE WHEN via IS NULL THEN eur ELSE 0 END) AS direct, sum(eur) AS total, bool_and(other) AS other FROM parts GROUP BY ALL), s AS (SELECT *, total / sum(total) OVER (PARTITION BY account_id) AS share FROM k) SELECT account_id, key, round(direct, 4) AS direct, round(total, 4) AS total, round(share, 8) AS share, other, NOT other AND share >= 0.1 AS warned FROM s")
def exposed_companies(spark, sf_dir):
    c = _exposure(spark, sf_dir).companies()
    return c.select("account_id", "key", F.round("direct", 4).alias("direct"), F.round("total", 4).alias("total"), F.round("share", 8).alias("share"), "other", "warned")


@query("agg39_exposed_sectors", f"{_EXPOSED}, s AS (SELECT account_id, sector, sum(eur) AS eur FROM parts GROUP BY ALL) SELECT account_id, sector, round(eur, 4) AS eur, round(eur / sum(eur) OVER (PARTITION BY account_id), 8) AS share FROM s")
def exposed_sectors(spark, sf_dir):
    return _exposure(spark, sf_dir).sectors().withColumns({"eur": F.round("eur", 4), "share": F.round("share", 8)})


@query(
    "agg39_exposed_countries",
    f"""{_EXPOSED}, w AS (SELECT account_id, n.country, value * pct / sum(pct) OVER (PARTITION BY account_id, ticker) AS eur FROM seen JOIN n ON n.fund = seen.fund
 UNION ALL SELECT account_id, 'Commodity', value FROM pos WHERE asset IS NOT NULL UNION ALL SELECT account_id, 'Unknown', value FROM uns UNION ALL SELECT account_id, substr(isin, 1, 2), value FROM dir UNION ALL SELECT DISTINCT account_id, 'Cash', 5000.0 FROM v_stakes), s AS (SELECT account_id, country, sum(eur) AS eur FROM w GROUP BY ALL)
SELECT account_id, country, round(eur, 4) AS eur, round(eur / sum(eur) OVER (PARTITION BY account_id), 8) AS share FROM s""",
)
def exposed_countries(spark, sf_dir):
    return _exposure(spark, sf_dir).by_country().withColumns({"eur": F.round("eur", 4), "share": F.round("share", 8)})
