"""Stored responses read again: pages of JSON as typed ledger rows, what is refused and why, and the order of linked pages.

Bodies are parsed as VARIANT, so one item's odd field costs neither the job nor the other pages. A page with an item that
doesn't fit its schema is refused whole; an item without a stable id ends its page there, as the rows before it count.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerwell.functions.money import MONEY
from ledgerwell.functions.storage import stored
from ledgerwell.operators.requests import classified_endpoint, replay_skips
from ledgerwell.sources.tables import upsert

NUMBER = "decimal(38,10)"


@dataclass(frozen=True)
class Field:
    """A column, where it stands in an item, its kind (text, id, number, time) and whether an item needs it."""

    name: str
    path: str
    kind: str
    needed: bool = False


#: What the items of each endpoint hold, as written by the provider.
SCHEMAS = {
    "orders": [
        Field("fill_id", "fill.id", "id"), Field("order_id", "order.id", "id"), Field("fill_timestamp", "fill.filledAt", "time"), Field("instrument_ticker", "order.instrument.ticker", "text"),
        Field("isin", "order.instrument.isin", "text"), Field("instrument_name", "order.instrument.name", "text"), Field("instrument_currency", "order.instrument.currency", "text"),
        Field("order_ticker", "order.ticker", "text"), Field("order_currency", "order.currency", "text"), Field("side", "order.side", "text"), Field("order_type", "order.type", "text"),
        Field("fill_type", "fill.type", "text"), Field("order_quantity", "order.quantity", "number"), Field("filled_quantity", "fill.quantity", "number"), Field("fill_price", "fill.price", "number"),
        Field("order_filled_value", "order.filledValue", "number"), Field("limit_price", "order.limitPrice", "number"), Field("stop_price", "order.stopPrice", "number"),
        Field("wallet_currency", "fill.walletImpact.currency", "text"), Field("wallet_net_value", "fill.walletImpact.netValue", "number"), Field("wallet_fx_rate", "fill.walletImpact.fxRate", "number"),
        Field("wallet_realised", "fill.walletImpact.realisedProfitLoss", "number"),
    ],
    "dividends": [
        Field("reference", "reference", "text", True), Field("paid_on", "paidOn", "time"), Field("instrument_ticker", "instrument.ticker", "text"), Field("isin", "instrument.isin", "text"),
        Field("item_ticker", "ticker", "text"), Field("dividend_type", "type", "text"), Field("currency", "currency", "text"), Field("ticker_currency", "tickerCurrency", "text"),
        Field("quantity", "quantity", "number"), Field("amount", "amount", "number"), Field("amount_in_euro", "amountInEuro", "number"), Field("gross_amount_per_share", "grossAmountPerShare", "number"),
    ],
    "transactions": [
        Field("reference", "reference", "text", True), Field("ts", "dateTime", "time"), Field("transaction_type", "type", "text"), Field("currency", "currency", "text"), Field("amount", "amount", "number"),
    ],
    "metadata": [
        Field("ticker", "ticker", "text", True), Field("isin", "isin", "text"), Field("name", "name", "text"), Field("short_name", "shortName", "text"), Field("currency", "currencyCode", "text"),
        Field("instrument_type", "type", "text"), Field("added_on", "addedOn", "time"), Field("max_open_quantity", "maxOpenQuantity", "number"),
    ],
}
KEYS = {"orders": "fill_id", "dividends": "reference", "transactions": "reference", "metadata": "ticker"}
#: Parts of an item that have to be objects where they are there at all; an order item needs its order.
OBJECTS = {"orders": ["order", "order.instrument", "fill", "fill.walletImpact"], "dividends": ["instrument"], "transactions": [], "metadata": []}


def _given(v: Column) -> Column:
    """Whether a variant is there and not a JSON null."""
    return v.isNotNull() & ~F.is_variant_null(v)


def _layout(paths: list[str]) -> str:
    """The type of an item whose leaves at these paths are variants, with the objects on the way as structs."""
    inner: dict[str, list[str]] = {}
    for p in paths:
        head, _, rest = p.partition(".")
        inner.setdefault(head, []).extend([rest] if rest else [])
    return "struct<" + ", ".join(f"`{k}`: {_layout(v) if v else 'variant'}" for k, v in inner.items()) + ">"


def _leaf(item: Column, path: str) -> Column:
    for part in path.split("."):
        item = item[part]
    return item


def _read(v: Column, kind: str) -> Column:
    """A value of a kind; null if it isn't one. Only texts of numbers can be cast to one, so numbers need no look at the type."""
    text = F.try_variant_get(v, "$", "string")
    if kind == "number":
        return F.trim(text).try_cast(NUMBER)
    found = F.schema_of_variant(v)
    if kind == "id":
        return F.when(found.isin("STRING", "BIGINT"), text)
    return F.when(found == "STRING", F.trim(text).try_cast("timestamp") if kind == "time" else text)


def admitted(responses: DataFrame) -> DataFrame:
    """responses(response_id, recorded_at, endpoint, status, body) with category, path and why a row isn't replayed (skip)."""
    kinds = classified_endpoint(F.col("endpoint"))
    return responses.withColumn("c_", kinds).withColumns({"category": F.col("c_.category"), "path": F.col("c_.path"), "skip": replay_skips(F.col("c_.category"), F.col("status"))}).drop("c_")


def page_rows(responses: DataFrame, category: str) -> DataFrame:
    """A row an item of each page of a category that is to be replayed, and one (place null) of a page without items.

    (response_id, recorded_at, path, place, the schema's fields, executed, listed, n_items, refused, taken): executed
    (orders: there is a fill), listed (with an instrument), n_items of the page if it fits its schema, else 0. refused names
    the first fault of a page that doesn't fit, else the place of an item without its id, else null; taken are the items
    before that. response_id is unique. Items are rows before they are read: a page is judged over its rows.
    """
    fields, key = SCHEMAS[category], KEYS[category]
    pages = admitted(responses).filter((F.col("category") == category) & F.col("skip").isNull()).select("response_id", "recorded_at", "path", F.try_parse_json("body").alias("v_"))
    pages = pages.withColumn("raw_", F.try_variant_get("v_", "$" if category == "metadata" else "$.items", "array<variant>"))
    unfit = F.when(F.col("v_").isNull(), "no JSON").when(F.col("raw_").isNull(), "no page of items")
    pages = pages.select("response_id", "recorded_at", "path", unfit.alias("unfit_"), F.coalesce(F.size("raw_"), F.lit(0)).alias("size_"), "raw_")
    items = pages.select("response_id", "recorded_at", "path", "unfit_", "size_", F.posexplode_outer("raw_").alias("place", "x_"))

    item, x = F.try_variant_get("x_", "$", _layout([f.path for f in fields])), F.col("x_")
    at = lambda path: F.try_variant_get(x, f"$.{path}", "variant")
    # what isn't an object has no struct, and it is a fault if something else stands there
    objects = [F.when(_leaf(item, p).isNull() & _given(at(p)), p) for p in OBJECTS[category]] + ([F.when(item["order"].isNull(), "order")] if category == "orders" else [])
    has = {"orders": "order.instrument", "dividends": "instrument"}.get(category)
    # a function of arrays keeps this step out of whole-stage code, where reading all fields is one method too long to be compiled
    there = F.exists(F.array("place"), lambda p: p.isNotNull())
    rows = items.select(
        "response_id", "recorded_at", "path", "unfit_", "size_", "place", there.alias("item_"), *[_read(_leaf(item, f.path), f.kind).alias(f.name) for f in fields], F.struct(*[_given(_leaf(item, f.path)).alias(f.name) for f in fields]).alias("there_"),
        F.when(item.isNull(), "item").otherwise(F.coalesce(*objects, F.lit(None).cast("string"))).alias("shape_"), (item["fill"].isNotNull() if category == "orders" else F.lit(True)).alias("executed"), (_leaf(item, has).isNotNull() if has else F.lit(False)).alias("listed"),
    )

    there = F.col("item_")
    faults = [F.when(F.col(f.name).isNull() & (F.col("there_")[f.name] | F.lit(f.needed)), f.path) for f in fields]
    rows = rows.withColumn("fault_", F.when(there, F.coalesce("shape_", *faults))).withColumn("nameless_", F.when(there & F.col("executed") & (F.coalesce(F.col(key), F.lit("")) == ""), F.col("place"))).drop("there_", "shape_")
    page = Window.partitionBy("response_id")
    rows = rows.withColumns({"wrong_": F.min(F.when(F.col("fault_").isNotNull(), F.struct("place", "fault_"))).over(page), "cut_": F.min("nameless_").over(page)})
    fits = F.col("unfit_").isNull() & F.col("wrong_").isNull()
    refused = F.coalesce("unfit_", F.when(F.col("wrong_").isNotNull(), F.concat(F.lit("item "), F.col("wrong_.place").cast("string"), F.lit(": "), F.col("wrong_.fault_"))), F.when(F.col("cut_").isNotNull(), F.concat(F.lit("item "), F.col("cut_").cast("string"), F.lit(": no id"))))
    taken = there & fits & F.col("executed") & (F.col("place") < F.coalesce("cut_", F.lit(2**31 - 1)))
    return rows.select("response_id", "recorded_at", "path", "place", *[f.name for f in fields], "executed", "listed", F.when(fits, F.col("size_")).otherwise(0).alias("n_items"), refused.alias("refused"), taken.alias("taken"))


def judged_pages(responses: DataFrame, category: str) -> DataFrame:
    """(response_id, path, refused, n_items) of each page of a category that is to be replayed."""
    return page_rows(responses, category).filter(F.coalesce("place", F.lit(0)) == 0).select("response_id", "path", "refused", "n_items")


def ledger_rows(responses: DataFrame, category: str) -> DataFrame:
    """The rows of a category, one a stable id: of several responses with it the newest one's, then the last of a page."""
    key = KEYS[category]
    own = lambda a, b: F.when(F.col("listed"), F.col(a)).otherwise(F.col(b))
    rows = page_rows(responses, category).filter("taken").drop("path", "executed", "n_items", "refused", "taken")
    if category == "orders":
        rows = rows.withColumns({"ticker": own("instrument_ticker", "order_ticker"), "instrument_currency": own("instrument_currency", "order_currency")}).drop("instrument_ticker", "order_ticker", "order_currency")
    if category == "dividends":
        rows = rows.withColumn("ticker", own("instrument_ticker", "item_ticker")).drop("instrument_ticker", "item_ticker")
    # a window and not an aggregate of whole rows: only the columns that are asked for go through its shuffle
    later = F.lead(F.lit(1)).over(Window.partitionBy(key).orderBy("recorded_at", "response_id", "place"))
    return rows.withColumn("later_", later).filter("later_ is null").drop("later_", "recorded_at", "response_id", "place", "listed")


def rejects(responses: DataFrame) -> DataFrame:
    """(response_id, path, reason) of all that isn't replayed: skipped, not fit, or cut short at an item without id."""
    skipped = admitted(responses).filter("skip is not null").select("response_id", "path", F.col("skip").alias("reason"))
    refused = [judged_pages(responses, c).filter("refused is not null").select("response_id", "path", F.col("refused").alias("reason")) for c in SCHEMAS]
    return reduce(DataFrame.unionByName, refused, skipped)


def reparse_report(responses: DataFrame) -> DataFrame:
    """(path, replayed, failed, skipped, items) of each endpoint."""
    parts = [judged_pages(responses, c).select("path", F.col("refused").isNull().cast("int").alias("replayed"), F.col("refused").isNotNull().cast("int").alias("failed"), F.lit(0).alias("skipped"), "n_items") for c in SCHEMAS]
    parts.append(admitted(responses).filter("skip is not null").select("path", F.lit(0).alias("replayed"), F.lit(0).alias("failed"), F.lit(1).alias("skipped"), F.lit(0).alias("n_items")))
    return reduce(DataFrame.unionByName, parts).groupBy("path").agg(*[F.sum(c).alias(c) for c in ("replayed", "failed", "skipped")], F.sum("n_items").alias("items"))


def rebuilt(existing: DataFrame, responses: DataFrame, category: str) -> DataFrame:
    """existing rows and those of the responses in their place; doing it again changes nothing.

    The rows are stored first: the responses are parsed once, though the rows' keys are asked for as well.
    """
    rows = stored(ledger_rows(responses, category).select(*existing.columns), "rebuilt")
    return upsert(existing, rows, [KEYS[category]])


def written_counts(existing: DataFrame, responses: DataFrame, category: str) -> DataFrame:
    """(new, unchanged): ids of the responses that existing lacks, and that it has."""
    key = KEYS[category]
    had = existing.select(key).distinct().withColumn("had_", F.lit(True))
    rows = ledger_rows(responses, category).select(key).join(had, key, "left")
    return rows.agg(F.count_if(F.col("had_").isNull()).alias("new"), F.count_if("had_").alias("unchanged"))


def fills(orders: DataFrame) -> DataFrame:
    """Rows of orders as a ledger's fills, without account."""
    return orders.select("fill_id", "fill_timestamp", "ticker", "side", "fill_type", F.col("filled_quantity").cast(MONEY).alias("quantity"), F.col("wallet_net_value").cast(MONEY).alias("net_value"), F.col("wallet_currency").alias("currency"))


def page_chains(pages: DataFrame, starts: DataFrame, most_pages: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Linked pages in order: (start, path, position), and (start, pages, status) of each start.

    pages(path, next_path) are stored responses, path unique; starts(start) where chains begin. A chain is followed until
    a page without a next one (complete), a path that it has been at (cycle), a path that isn't stored (missing), or
    `most_pages` pages with one more to come (too long). Links are followed by doubling: round k knows for every page the
    one 2^k further on and appends to each chain as many pages as it has, so log2(most_pages) joins do.
    """
    hop = stored(pages.select("path", "next_path"), "hops")
    reached = stored(starts.select("start", F.col("start").alias("path"), F.lit(0).alias("position")), "reached")
    end_of, step, links = hop, 1, hop
    while step <= most_pages:
        further = reached.join(links.filter("next_path is not null"), "path").select("start", F.col("next_path").alias("path"), (F.col("position") + step).alias("position")).filter(F.col("position") <= most_pages)
        longer = stored(reached.unionByName(further), "reached")
        grown = further.limit(1).count()
        reached = longer
        if not grown:
            break
        there = links.select(F.col("path").alias("next_path"), F.col("next_path").alias("after"))
        links = stored(links.join(there, "next_path").filter("after is not null").select("path", F.col("after").alias("next_path")), "hops")
        step *= 2
    first = reached.groupBy("start", "path").agg(F.min("position").alias("position"), F.max("position").alias("furthest"), F.count_if(F.col("position") < most_pages).alias("times"))
    known = first.join(end_of.withColumn("stored_", F.lit(True)), "path", "left")
    in_reach = known.filter(F.col("stored_") & (F.col("position") < most_pages))
    ends = known.groupBy("start").agg(
        F.bool_or("stored_").alias("any_"), F.count_if(F.col("stored_") & (F.col("position") < most_pages)).cast("long").alias("pages"), F.bool_or(F.col("times") > 1).alias("again_"),
        F.bool_or(F.col("stored_").isNull() & (F.col("position") < most_pages)).alias("lost_"), F.bool_or(F.col("furthest") >= most_pages).alias("long_"),
    )
    status = F.when(F.col("again_"), "cycle").when(F.col("lost_"), "missing").when(F.col("long_"), "too long").otherwise("complete")
    return in_reach.select("start", "path", "position"), ends.select("start", "pages", status.alias("status"))
