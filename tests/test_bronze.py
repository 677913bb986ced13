"""Batches of news, stored responses and linked pages: cases worked by hand and against plain versions."""

import random
from datetime import datetime, timedelta

import pytest

from ledgerwell.operators import merging
from ledgerwell.plans import bronze as pb
from ledgerwell.sources import bronze as bz

NOW = datetime(2024, 5, 1, 12)
ITEM = "item_id long, canonical string, title string, ts timestamp, trust int, headline string"


def one_by_one(rows, hours=48):
    kept = []
    order = lambda r: (-(r[4] or 0), r[3] is None, -(r[3] or NOW).timestamp() if r[3] else 0, r[5] or "", r[1] or "", r[0])
    for r in sorted(rows, key=order):
        same = lambda k, r=r: k[2] == r[2] and (r[2] or "") != "" and (k[3] is None or r[3] is None or abs(k[3] - r[3]) <= timedelta(hours=hours))
        if not any((k[1] is not None and k[1] == r[1]) or same(k) for k in kept):
            kept.append(r)
    return {k[0] for k in kept}


def merged(spark, rows, **how):
    return {r[0] for r in merging.merge_batch(spark.createDataFrame(rows, ITEM), **how).collect()}


@pytest.mark.parametrize("finish", [0, 1000])
def test_one_story_stays_once(spark, finish):
    row = lambda i, url, title, days=0, trust=50: (i, url, title, None if days is None else NOW + timedelta(days=days), trust, title)
    cases = [
        ([row(1, "https://yh/1", "apple 8 k filed", trust=40), row(2, "https://sec/1", "apple 8 k filed", trust=100)], {2}),
        ([row(1, "https://x/s", "one", trust=50), row(2, "https://x/s", "other wording", trust=40)], {1}),
        ([row(1, "https://x/1", "weekly wrap"), row(2, "https://x/2", "weekly wrap", 7)], {1, 2}),
        ([row(1, "https://x/1", "apple beats"), row(2, "https://x/2", "shell buys back")], {1, 2}),
        ([row(1, "https://x/1", "wrap", None), row(2, "https://x/2", "wrap", 0), row(3, "https://x/3", "wrap", 9)], {2, 3}),
        ([row(1, "https://x/1", "wrap", None, 90), row(2, "https://x/2", "wrap", 0), row(3, "https://x/3", "wrap", 9)], {1}),
        ([row(1, None, ""), row(2, None, "", 1), row(3, None, None, None)], {1, 2, 3}),
        ([row(i, f"u{i}", "t", i * 1.5) for i in range(8)], {7, 5, 3, 1}),
        ([], set()),
    ]
    for rows, want in cases:
        assert one_by_one(rows) == want and merged(spark, rows, finish_rows=finish) == want


@pytest.mark.parametrize("finish", [0, 40, 1000])
def test_batch_equals_one_by_one(spark, finish):
    rng = random.Random(finish)
    rows = [
        (i, rng.choice([None, *[f"u{k}" for k in range(60)]]), rng.choice(["", None, "a", "b", *"cdefghij"]), rng.choice([None, *[NOW + timedelta(hours=rng.randint(0, 900))] * 9]), rng.choice([None, 10, 20, 30]), rng.choice(["x", "y", None]))
        for i in range(160)
    ]
    assert merged(spark, rows, finish_rows=finish) == one_by_one(rows)


RESPONSE = "response_id long, recorded_at timestamp, endpoint string, status int, body string"
ORDERS, DIVIDENDS = "/equity/history/orders", "/equity/history/dividends"


def fill(name, quantity="1.5", **more):
    return f'{{"order": {{"id": 7, "side": "BUY", "ticker": "T", "currency": "GBX", "quantity": 99}}, "fill": {{"id": {name}, "quantity": {quantity}, "price": "205.0000", "type": "TRADE"}}}}'


def test_pages_become_rows_or_rejects(spark):
    page = lambda *items: '{"items": [' + ", ".join(items) + '], "nextPagePath": null}'
    instrument = '{"order": {"id": "o", "ticker": "OLD", "instrument": {"ticker": "NEW", "isin": "I"}}, "fill": {"id": "f9", "filledAt": "2024-01-31T08:30:00+02:00", "quantity": 1, "walletImpact": {"netValue": 10.25}}}'
    rows = [
        (1, NOW, ORDERS, 200, page(fill('"f1"'), fill("2"))), (2, NOW, ORDERS, 500, page(fill('"f3"'))), (3, NOW, ORDERS, 200, '{"not": "a page"}'), (4, NOW, "/equity/positions", 200, "[]"),
        (5, NOW, "/equity/account/summary", 200, "{}"), (6, NOW, ORDERS, 200, page(fill('"f4"'), fill("null"), fill('"f5"'))), (7, NOW, ORDERS, 200, page(fill('"f6"'), fill('"f7"', '{"a": 1}'))),
        (8, NOW, ORDERS, 200, page('{"order": {"id": 1}, "fill": null}', '{"order": {"id": 2}}')), (9, NOW, ORDERS + "?cursor=3", 200, "{truncated"), (10, NOW - timedelta(days=1), ORDERS, 200, page(fill('"f1"', "7"))),
        (11, NOW, DIVIDENDS, 200, page('{"reference": "d1", "amount": 1.10, "ticker": "T"}')), (12, NOW, DIVIDENDS, 200, page('{"amount": 1}')), (13, NOW, ORDERS, 200, None), (14, NOW, ORDERS, 200, page(instrument)),
        (15, NOW, DIVIDENDS, 200, page('{"reference": "d2", "instrument": {"name": "N"}, "ticker": "T"}', '{"reference": ""}')), (16, NOW, ORDERS, 200, page('{"fill": {"id": 1}}')), (17, NOW, ORDERS, 200, page()),
    ]
    responses = spark.createDataFrame(rows, RESPONSE)
    orders = {r["fill_id"]: r for r in bz.ledger_rows(responses, "orders").collect()}
    assert set(orders) == {"f1", "2", "f4", "f9"}
    assert (float(orders["f1"]["filled_quantity"]), orders["f1"]["ticker"], orders["f1"]["instrument_currency"], float(orders["f1"]["fill_price"]), orders["f1"]["order_id"]) == (1.5, "T", "GBX", 205.0, "7")
    assert (orders["f9"]["ticker"], orders["f9"]["isin"], orders["f9"]["instrument_currency"], orders["f9"]["fill_timestamp"].isoformat(), float(orders["f9"]["wallet_net_value"])) == ("NEW", "I", None, "2024-01-31T06:30:00", 10.25)
    paid = {r["reference"]: (r["ticker"], r["amount"]) for r in bz.ledger_rows(responses, "dividends").collect()}
    assert {k: v[0] for k, v in paid.items()} == {"d1": "T", "d2": None} and float(paid["d1"][1]) == 1.1
    why = {r["response_id"]: r["reason"] for r in bz.rejects(responses).collect()}
    assert {k: why[k] for k in (3, 6, 7, 9, 12, 13, 15, 16)} == {3: "no page of items", 6: "item 1: no id", 7: "item 1: fill.quantity", 9: "no JSON", 12: "item 0: reference", 13: "no JSON", 15: "item 1: no id", 16: "item 0: order"}
    assert "status 500" in why[2] and "live-state" in why[4] and "unrecognised" in why[5] and not {1, 8, 10, 11, 14, 17} & set(why)
    report = {r["path"]: tuple(r)[1:] for r in bz.reparse_report(responses).collect()}
    assert report[ORDERS] == (5, 6, 1, 9) and report[DIVIDENDS] == (1, 2, 0, 3)

    had = spark.createDataFrame([("f1", "old"), ("x", "other")], "fill_id string, side string")
    once = bz.rebuilt(had, responses, "orders")
    assert {tuple(r) for r in once.collect()} == {("f1", "BUY"), ("2", "BUY"), ("f4", "BUY"), ("f9", None), ("x", "other")}
    assert sorted(bz.rebuilt(once, responses, "orders").collect()) == sorted(once.collect())
    assert tuple(bz.written_counts(had, responses, "orders").first()) == (3, 1) and tuple(bz.written_counts(once, responses, "orders").first()) == (0, 4)
    empty = responses.limit(0)
    assert bz.ledger_rows(empty, "orders").count() == bz.rejects(empty).count() == bz.reparse_report(empty).count() == 0


def test_linked_pages(spark):
    links = [(f"a{i}", f"a{i + 1}") for i in range(1, 9)] + [("a9", None), ("c1", "c1"), ("d1", "d2"), ("d2", "d3"), ("d3", "d2"), ("m1", "gone"), ("solo", None)]
    pages = spark.createDataFrame(links, "path string, next_path string")
    starts = spark.createDataFrame([(s,) for s in ("a1", "c1", "d1", "m1", "solo", "never")], "start string")

    def plain(start, most):
        nexts, at, seen = dict(links), start, []
        while at is not None:
            if at in seen:
                return seen, "cycle"
            if at not in nexts:
                return seen, "missing"
            seen.append(at)
            at = nexts[at]
            if at is not None and len(seen) >= most:
                return seen, "too long"
        return seen, "complete"

    for most in (1, 2, 5, 8, 9, 10, 1000):
        order, ends = bz.page_chains(pages, starts, most)
        want = {s: plain(s, most) for s in ("a1", "c1", "d1", "m1", "solo", "never")}
        assert {r["start"]: (r["pages"], r["status"]) for r in ends.collect()} == {s: (len(p), e) for s, (p, e) in want.items()}
        assert {tuple(r) for r in order.collect()} == {(s, p, i) for s, (ps, _) in want.items() for i, p in enumerate(ps)}


def test_rebuilding_parses_once_and_broadcasts_no_keys(spark, monkeypatch):
    parsed = []
    rows = bz.ledger_rows
    monkeypatch.setattr(bz, "ledger_rows", lambda *a: parsed.append(a) or rows(*a))
    body = '{"items": [{"order": {"id": 1}, "fill": {"id": "f1", "quantity": 3}}, {"order": {"id": 2}, "fill": {"id": "f2", "quantity": "4"}}]}'
    responses = spark.createDataFrame([(1, NOW, ORDERS, 200, body)], RESPONSE)
    had = spark.createDataFrame([("f1", 1), ("f1", 1), ("f3", 5)], "fill_id string, filled_quantity int").selectExpr("fill_id", f"cast(filled_quantity as {bz.NUMBER}) as filled_quantity")
    out = bz.rebuilt(had, responses, "orders")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert len(parsed) == 1 and "from_json" not in plan and "parse_json" not in plan and "Broadcast" not in plan
    assert sorted((r[0], int(r[1])) for r in out.collect()) == [("f1", 3), ("f2", 4), ("f3", 5)]


def test_rows_of_a_ledger_are_read_once_and_shuffled_narrow(spark, monkeypatch):
    """The shuffles carry what is asked for: before, the whole item of 22 fields went through them, and each page's text."""
    rows = bz.fills(bz.ledger_rows(pb._order_pages(spark, "/root/testdata/sf0.001"), "orders")).select("fill_id", "quantity")
    steps = rows._jdf.queryExecution().executedPlan().toString().split("\n")
    below = [steps[i + 1] for i, line in enumerate(steps) if "Exchange hashpartitioning" in line]
    assert len(below) == 2 and not any(c in line for line in below for c in ("isin", "limit_price", "wallet_realised", "body"))
    assert "fill_id" in below[0] and "l_orderkey" in below[1] and "Broadcast" not in "".join(steps)
    generated = [line for line in steps if "posexplode" in line]
    assert len(generated) == 1 and sum("parseJson" in line for line in steps) == 1 and generated[0].split("[", 1)[1].split("]")[0].count("#") == 3


def test_pages_are_judged_whole_wherever_their_items_are(spark):
    """A fault of the last item refuses all of a page, an item without its id what follows it, in many partitions and one."""
    item = '{"order": {"id": %d}, "fill": {"id": %s, "quantity": %s}}'
    page = lambda bad, nameless: '{"items": [' + ", ".join(item % (i, "null" if i == nameless else f'"p{bad}-{nameless}-{i}"', "true" if i == bad else "1") for i in range(9)) + "]}"
    kinds = [(b, n) for b in (-1, 0, 8) for n in (-1, 0, 4, 8)]
    responses = spark.createDataFrame([(i, NOW, ORDERS, 200, page(*k)) for i, k in enumerate(kinds)], RESPONSE)
    want = {f"p{b}-{n}-{i}" for b, n in kinds if b < 0 for i in range(9 if n < 0 else n)}
    for parts in (1, 5):
        spread = responses.repartition(parts)
        assert {r[0] for r in bz.ledger_rows(spread, "orders").select("fill_id").collect()} == want
        assert {r[0]: r[2] for r in bz.rejects(spread).collect()} == {i: f"item {b}: fill.quantity" if b >= 0 else f"item {n}: no id" for i, (b, n) in enumerate(kinds) if (b, n) != (-1, -1)}
        assert [tuple(r)[1:] for r in bz.reparse_report(spread).collect()] == [(1, 11, 0, 9 * 4)]


def test_of_many_versions_of_a_row_the_newest_stays(spark):
    item = '{"order": {"id": 1}, "fill": {"id": "f", "quantity": %d}}'
    at = [(3, 0, [5]), (1, 1, [7, 8]), (2, 1, [9, 10]), (9, -1, [11])]
    responses = spark.createDataFrame([(i, NOW + timedelta(days=d), ORDERS, 200, '{"items": [' + ", ".join(item % q for q in qs) + "]}") for i, d, qs in at], RESPONSE)
    assert [int(r[0]) for r in bz.ledger_rows(responses.repartition(4), "orders").select("filled_quantity").collect()] == [10]
