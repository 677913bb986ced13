"""Queries over stored responses and batches of news, made from the driver's tables, with SQL for the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerwell.operators import merging
from ledgerwell.sources import bronze as bz

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def _table(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_BATCH = """
SELECT page_id AS item_id, CASE WHEN page_id % 13 = 0 THEN NULL ELSE concat('https://n.org/', CAST(page_id - page_id % 3 AS VARCHAR(20))) END AS canonical,
  CASE WHEN page_id % 17 = 0 THEN '' ELSE concat('story ', CAST(page_id - page_id % 40 + page_id % 5 AS VARCHAR(20))) END AS title, concat('Story ', CAST(page_id % 7 AS VARCHAR(9))) AS headline,
  CASE WHEN page_id % 11 = 0 THEN NULL ELSE TIMESTAMP '2024-01-01 00:00:00' + page_id * 17 % 90 * INTERVAL '8' HOUR END AS ts, CAST(page_id * 7 % 3 * 10 AS INTEGER) AS trust
FROM {pages}"""


@query("join15_merged_batch", f"""WITH RECURSIVE b AS ({_BATCH.replace('{pages}', 'pages')}), o AS (SELECT *, row_number() OVER (ORDER BY trust DESC, ts IS NULL, ts DESC, headline, coalesce(canonical, ''), item_id) AS rn FROM b),
  g AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(item_id BIGINT, canonical VARCHAR, title VARCHAR, ts TIMESTAMP)[]) AS kept UNION ALL
  SELECT n + 1, CASE WHEN len(list_filter(kept, lambda k: k.canonical = o.canonical OR (k.title = o.title AND o.title <> '' AND (k.ts IS NULL OR o.ts IS NULL OR abs(epoch(k.ts) - epoch(o.ts)) <= 172800)))) = 0
    THEN list_append(kept, {{'item_id': o.item_id, 'canonical': o.canonical, 'title': o.title, 'ts': o.ts}}) ELSE kept END FROM g JOIN o ON o.rn = g.n + 1)
SELECT unnest(kept).item_id AS item_id FROM g WHERE n = (SELECT count(*) FROM b)""")
def merged_batch(spark, sf_dir):
    items = spark.sql(_BATCH, pages=_table(spark, sf_dir, "pages"))
    return merging.merge_batch(items, finish_rows=0)


def _fill_id():
    return F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])


def _order_pages(spark, sf_dir) -> DataFrame:
    """Pages of 32 order keys with their lines as items; some cannot be read, and some were stored before in another state."""
    # a line goes to its pages as it is, and is written out there: no text is shuffled
    line, page, new = F.col("l_linenumber"), F.expr("l_orderkey div 32"), F.col("recorded") == 1
    li = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate")
    li = li.select("*", page.alias("page"), F.explode(F.when(page % 2 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))).alias("recorded"))
    li = li.withColumn("response_id", F.col("page") * 2 + F.col("recorded")).repartition("response_id")
    text = lambda c: c.cast("decimal(18,2)").cast("string")
    price = F.when(new & (F.col("page") % 17 == 1) & (line == 2), "n/a").otherwise(text(F.col("l_extendedprice")))
    quantity = text(F.when(new, F.col("l_quantity")).otherwise(F.col("l_quantity") + 1))
    instrument = F.when(line != 5, F.struct(F.concat(F.lit("T"), F.col("l_partkey").cast("string")).alias("ticker"), F.lit("EUR").alias("currency")))
    order = F.struct(F.col("l_orderkey").alias("id"), instrument.alias("instrument"), F.when(line == 5, F.concat(F.lit("O"), F.col("l_partkey").cast("string"))).alias("ticker"), F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"))
    impact = F.struct(F.lit("EUR").alias("currency"), text(F.col("l_extendedprice")).alias("netValue"))
    fill_id = F.when(~((F.col("page") % 19 == 2) & (line == 3)), _fill_id())
    fill = F.when(line != 6, F.struct(fill_id.alias("id"), F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("filledAt"), price.alias("price"), quantity.alias("quantity"), F.lit("TRADE").alias("type"), impact.alias("walletImpact")))
    item = F.to_json(F.struct(order.alias("order"), fill.alias("fill")), {"ignoreNullFields": "false"})
    items = F.sort_array(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", item.alias("x"))))
    pages = li.groupBy("response_id", "page", "recorded").agg(F.array_join(items["x"], ",").alias("items"))
    whole = F.concat(F.lit('{"items":['), F.col("items"), F.lit('],"nextPagePath":"/more"}'))
    return pages.select(
        "response_id", F.when(new, F.lit("2024-01-02")).otherwise("2024-01-01").cast("timestamp").alias("recorded_at"), F.lit("/equity/history/orders?cursor=1").alias("endpoint"),
        F.when(new & (F.col("page") % 13 == 0), 503).otherwise(200).alias("status"), F.when(new & (F.col("page") % 23 == 3), F.left(whole, F.lit(40))).otherwise(whole).alias("body"),
    )


_LINES = """l AS (SELECT l_orderkey // 32 AS page, row_number() OVER (PARTITION BY l_orderkey // 32 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS k, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS fill_id, CASE WHEN l_linenumber = 5 THEN 'O' ELSE 'T' END || l_partkey AS ticker, CASE l_returnflag WHEN 'R' THEN 'SELL' ELSE 'BUY' END AS side,
  CAST(l_quantity AS DOUBLE) AS quantity, CAST(l_extendedprice AS DOUBLE) AS net_value, CAST(l_shipdate AS DATE) AS day, l_linenumber AS line FROM lineitem),
cut AS (SELECT page, min(k) AS k FROM l WHERE page % 19 = 2 AND line = 3 GROUP BY page), bad AS (SELECT DISTINCT page FROM l WHERE page % 13 = 0 OR (page % 17 = 1 AND line = 2) OR page % 23 = 3),
good AS (SELECT l.* FROM l LEFT JOIN cut USING (page) WHERE line <> 6 AND page NOT IN (SELECT page FROM bad) AND (cut.k IS NULL OR l.k < cut.k)),
before AS (SELECT l.* REPLACE (quantity + 1 AS quantity) FROM l LEFT JOIN cut USING (page) WHERE line <> 6 AND page % 2 = 0 AND (cut.k IS NULL OR l.k < cut.k)),
f AS (SELECT * FROM good UNION ALL SELECT * FROM before WHERE fill_id NOT IN (SELECT fill_id FROM good))"""


@query("prj01_ledger_fills", f"WITH {_LINES} SELECT fill_id, ticker, side, quantity, net_value, strftime(day, '%Y-%m-%d') AS day FROM f")
def ledger_fills(spark, sf_dir):
    rows = bz.fills(bz.ledger_rows(_order_pages(spark, sf_dir), "orders"))
    return rows.select("fill_id", "ticker", "side", F.col("quantity").cast("double").alias("quantity"), F.col("net_value").cast("double").alias("net_value"), F.date_format("fill_timestamp", "yyyy-MM-dd").alias("day"))


@query("txt05_rebuilt_ledger", f"WITH {_LINES}, had AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS fill_id, CAST(-1 AS DOUBLE) AS quantity FROM lineitem WHERE l_linenumber IN (1, 6)) SELECT fill_id, quantity FROM f UNION ALL SELECT * FROM had WHERE fill_id NOT IN (SELECT fill_id FROM f)")
def rebuilt_ledger(spark, sf_dir):
    had = _table(spark, sf_dir, "lineitem").filter("l_linenumber in (1, 6)").select(_fill_id().alias("fill_id"), F.lit(-1).cast(bz.NUMBER).alias("filled_quantity"))
    return bz.rebuilt(had, _order_pages(spark, sf_dir), "orders").select("fill_id", F.col("filled_quantity").cast("double").alias("quantity"))


def _other_responses(spark, sf_dir) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    page = F.expr("event_id div 50")
    item = F.struct("event_id", F.struct(F.when(F.col("event_id") % 97 == 5, "").otherwise(F.col("event_id").cast("string")).alias("reference"), F.round("value", 2).alias("amount"), F.col("event_type").alias("type"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("dateTime")).alias("x"))
    rows = e.groupBy(page.alias("page")).agg(F.array_sort(F.collect_list(item)).alias("rows"))
    tx = rows.select("page", F.lit("https://h.org/api/v0/equity/history/transactions?limit=50").alias("endpoint"), F.to_json(F.struct(F.transform("rows", lambda r: r["x"]).alias("items"))).alias("body"))
    part = _table(spark, sf_dir, "part").groupBy(F.expr("p_partkey div 40").alias("page")).agg(F.to_json(F.collect_list(F.struct(F.col("p_brand").alias("ticker"), F.col("p_name").alias("name"), F.lit(True).alias("extendedHours")))).alias("body"))
    meta = part.select("page", F.lit("/equity/metadata/instruments").alias("endpoint"), F.when(F.col("page") % 5 == 0, F.lit('{"items": []}')).otherwise(F.col("body")).alias("body"))
    live = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("page"), F.when(F.col("s_suppkey") % 2 == 0, "/equity/positions").otherwise("/equity/account/summary").alias("endpoint"), F.lit("[]").alias("body"))
    return tx.unionByName(meta).unionByName(live).select((-F.col("page")).alias("response_id"), F.lit("2024-01-01").cast("timestamp").alias("recorded_at"), "endpoint", F.lit(200).alias("status"), "body")


@query("txt05_reparse_report", f"""WITH {_LINES}, p AS (SELECT page, 1 AS new, count(*) AS n FROM l GROUP BY page UNION ALL SELECT page, 0, count(*) FROM l WHERE page % 2 = 0 GROUP BY page),
c AS (SELECT '/equity/history/orders' AS path, CASE WHEN new = 1 AND page % 13 = 0 THEN 'skipped' WHEN (new = 1 AND page IN (SELECT page FROM bad)) OR page IN (SELECT page FROM cut) THEN 'failed' ELSE 'replayed' END AS r, CASE WHEN new = 1 AND page IN (SELECT page FROM bad) THEN 0 ELSE n END AS n FROM p
 UNION ALL SELECT '/equity/history/transactions', CASE WHEN bool_or(event_id % 97 = 5) THEN 'failed' ELSE 'replayed' END, count(*) FROM events GROUP BY event_id // 50
 UNION ALL SELECT '/equity/metadata/instruments', CASE WHEN p_partkey // 40 % 5 = 0 THEN 'failed' ELSE 'replayed' END, CASE WHEN p_partkey // 40 % 5 = 0 THEN 0 ELSE count(*) END FROM part GROUP BY p_partkey // 40
 UNION ALL SELECT CASE s_suppkey % 2 WHEN 0 THEN '/equity/positions' ELSE '/equity/account/summary' END, 'skipped', 0 FROM supplier)
SELECT path, count(*) FILTER (r = 'replayed') AS replayed, count(*) FILTER (r = 'failed') AS failed, count(*) FILTER (r = 'skipped') AS skipped, CAST(sum(n) AS BIGINT) AS items FROM c GROUP BY path""")
def reparse_report(spark, sf_dir):
    return bz.reparse_report(_order_pages(spark, sf_dir).unionByName(_other_responses(spark, sf_dir)))


def _chained(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Every customer's orders as linked pages; some chains turn back, some lead to a page that isn't stored."""
    o = _table(spark, sf_dir, "orders")
    by = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    path = lambda c: F.concat(F.lit("/orders?c="), c.cast("string"))
    after = F.coalesce(F.lead("o_orderkey").over(by).cast("string"), F.when(F.col("o_custkey") % 5 == 3, F.min("o_orderkey").over(by).cast("string")).when(F.col("o_custkey") % 5 == 4, F.lit("lost")))
    pages = o.select(path(F.col("o_orderkey")).alias("path"), path(after).alias("next_path"))
    return pages, o.groupBy("o_custkey").agg(path(F.min("o_orderkey")).alias("start")).select("start")


_CHAINS = "WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS position, concat('/orders?c=', min(o_orderkey) OVER (PARTITION BY o_custkey)) AS start FROM orders)"


@query("src02_page_order", f"{_CHAINS} SELECT start, concat('/orders?c=', o_orderkey) AS path, CAST(position AS INTEGER) AS position FROM o WHERE position < 12")
def page_order(spark, sf_dir):
    return bz.page_chains(*_chained(spark, sf_dir), most_pages=12)[0]


@query("src02_chain_status", f"{_CHAINS} SELECT start, least(count(*), 12) AS pages, CASE WHEN count(*) > 12 OR (count(*) = 12 AND o_custkey % 5 IN (3, 4)) THEN 'too long' WHEN o_custkey % 5 = 3 THEN 'cycle' WHEN o_custkey % 5 = 4 THEN 'missing' ELSE 'complete' END AS status FROM o GROUP BY start, o_custkey")
def chain_status(spark, sf_dir):
    return bz.page_chains(*_chained(spark, sf_dir), most_pages=12)[1]
