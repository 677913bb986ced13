"""URL rules, HTML extraction and pseudonyms on small inputs, against brute force where there is one."""

import math
import random
import time

from pyspark.sql import functions as F

from ledgerwell.llm import pseudonyms as ps
from ledgerwell.llm.site_templates import main_text, parse_blocks
from ledgerwell.llm.url_rules import RULE_SCHEMA, judge_urls


def _brute(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = rest[:cut].translate({i: i + 32 for i in range(65, 91)}), rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, 0, None, default))
    return host, path, best[2], best[3]


def test_url_rules_match_brute_force(spark):
    rng = random.Random(5)
    hosts = ["com", "a.com", "b.a.com", "xa.com", "net", "a.net", "A.Com", "a.b"]
    rules = [("com", "/en/", "block"), ("a.com", "/en/7", "allow"), ("a.com", "", "block"), ("b.a.com", "/", "allow"), ("net", "/de/", "allow"), ("net", "/de/8", "block"), ("com", "/", "allow"), ("com", "/", "block"), ("a.net", "bad", "block"), ("", "/x", "block")]
    known = [r for r in rules if r[0] and (r[1] == "" or r[1].startswith("/")) and r != ("com", "/", "allow")]
    urls = [f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}{rng.choice(['', '/en/7', '/en/71?x=1', '/de/8#t', '/de/', '/'])}" for _ in range(200)]
    urls += [None, "", "no scheme", "x://", "http://?q", urls[0], urls[0]]
    pages = spark.createDataFrame([(i, u, "kept") for i, u in enumerate(urls)], "page_id int, url string, Host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages, spark.createDataFrame(rules, RULE_SCHEMA)).collect()}
    assert got == {i: _brute(u, known) for i, u in enumerate(urls)}


def test_url_rules_of_empty_tables(spark):
    rules = spark.createDataFrame([], RULE_SCHEMA)
    pages = spark.createDataFrame([(1, "http://a.com/x")], "page_id int, url string")
    assert [r.verdict for r in judge_urls(pages, rules, default="block").collect()] == ["block"]
    assert judge_urls(pages.filter("false"), spark.createDataFrame([("com", "/", "block")], RULE_SCHEMA)).count() == 0


def test_url_sweep_runs_in_dataframe_operations(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x")], "page_id int, url string")
    plan = judge_urls(pages, spark.createDataFrame([("com", "/", "block")], RULE_SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "Window" in plan


def test_parse_blocks_survives_broken_markup():
    assert parse_blocks("") == ([], [])
    assert parse_blocks("<p>a<br>b<p>c &amp; d</b></p><script>var x='</p>'</script>e<!-- f")[0] == ["a", "b", "c & d", "e"]
    assert parse_blocks("<div class='side menu'>x</div>y")[0] == ["y"]
    assert parse_blocks("<p data-x=it's>Hello. It's fine</p>")[0] == ["Hello. It's fine"]
    assert parse_blocks("a<svg/>b<svg x='1' /><p>c</p><svg>no</svg>d")[0] == ["a", "b", "c", "d"]
    assert parse_blocks("<p>a</p><div hidden>b</div><p style='display: none'>c</p><div style='display:block' class=\"x\">d</div>")[0] == ["a", "d"]
    assert parse_blocks("<p a=\"b>c")[0] == ["c"] and parse_blocks('<a title="x>y">t</a>')[0] == ["t"]


def test_long_and_deep_pages_take_linear_time():
    for page in ("<article><table>" + "<tr><td>x</td></tr>" * 30_000, "<div>x" * 20_000, "<article><div class=ad>x" * 10_000, "<p a='" * 50_000, "<x>" * 20_000 + "<li>y" * 20_000):
        began = time.perf_counter()
        parse_blocks(page)
        assert time.perf_counter() - began < 5, page[:30]


def test_subtrees_match_brute_force():
    page = "<body><div><div>One two three four</div><p>five six seven</p></div><ul><li>eight nine ten eleven</ul><div class=ad>x</div><section>One two three four</section></body>"
    blocks, subtrees = parse_blocks(page, 1)
    ranges = sorted((tuple(blocks[i:j])) for _, i, j in subtrees)
    assert ranges == sorted([("One two three four",), ("One two three four", "five six seven"), ("five six seven",), ("eight nine ten eleven",), ("eight nine ten eleven",), ("One two three four",)])
    by = {}
    for h, i, j in parse_blocks("<div>a b</div><div>a b</div><section>a b</section><div>a</div><div>b</div><div>a<br>b</div>", 1)[1]:
        by.setdefault(h, []).append((i, j))
    assert sorted(len(x) for x in by.values()) == [1, 1, 1, 1, 2]


def test_template_counts_match_brute_force(spark):
    rng = random.Random(9)
    parts = [f"<div>Part number {i} of the site</div>" for i in range(12)]
    rows = [(i, f"http://h{i % 3}.com/{i}", "".join(rng.sample(parts, rng.randrange(6))) + f"<p>The text of page {rng.randrange(40)} itself</p>") for i in range(90)]
    rows += [(100 + i, "http://h0.com/", rows[0][2]) for i in range(15)]
    want = {}
    for host in range(3):
        mine = {i: parse_blocks(h) for i, u, h in rows if f"//h{host}." in u}
        distinct = {tuple(b): (b, t) for b, t in mine.values()}
        count = {}
        for _, t in distinct.values():
            for h in {x[0] for x in t}:
                count[h] = count.get(h, 0) + 1
        need = max(3, min(10, math.ceil(0.5 * len(distinct))), math.ceil(0.01 * len(distinct)))
        for i, (b, t) in mine.items():
            gone = {k for h, a, z in t if count[h] >= need for k in range(a, z)}
            want[i] = " ".join(x for k, x in enumerate(b) if k not in gone)
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert got == want and any("Part" not in v for v in want.values())


def test_main_text_drops_templates_of_a_host(spark):
    page = "<html><body><div>Buy our great paper today</div><article><h1>T{0}</h1><p>Body <b>n</b>o {0} &eacute;&nbsp;x</p><p>A shared passage of the articles</p></article><div class='comments'>c</div><footer>f</footer></body></html>"
    rows = [(i, "http://h.com/a", page.format(i)) for i in range(12)] + [(100, "http://other.com/", page.format(100)), (101, "http://h.com/b", None), (102, None, ""), (103, "x", "plain <b>te</b>xt")]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert got[3] == "T3 Body no 3 é x A shared passage of the articles"
    assert got[100] == "Buy our great paper today T100 Body no 100 é x A shared passage of the articles"
    assert got[101] == got[102] == "" and got[103] == "plain text"
    assert main_text(spark.createDataFrame([], "page_id int, url string, html string")).count() == 0


def _left(page):
    return " ".join(parse_blocks(page)[0])


def test_wrappers_of_the_page_are_no_asides():
    nav, body = "<nav>Home About</nav><div class='sidebar'>Ads</div>", "<p>Long text of the page</p><p>and more of it</p>"
    want = "Long text of the page and more of it"
    for opening, closing in [
        ("<body class='has-sidebar'>", "</body>"), ("<html class='no-cookie'><body>", "</body></html>"), ("<body><div id='page' class='site header-fixed'><article>", "</article></div></body>"),
        ("<body><article class='post comment-open'>", "</article></body>"), ("<body><main role='form' class='widget'>", "</main></body>"), ("<form id='aspnetForm'><main>", "</main></form>"),
        ("<form id='aspnetForm'><div>", "</div></form>"), ("<body><div class='page menu-open'>", "</div></body>"), ("<main><div class='post comment-open'>", "</div></main>"),
    ]:
        assert _left(opening + nav + body + closing) == want, opening
    assert _left(f"<div class='sidebar'>{'x ' * 99}</div><article><p>Short</p></article>") == "Short"
    assert _left(f"<nav>{'x ' * 99}</nav><p>Short</p>") == "Short"
    assert _left("<article><p>The text of the post</p></article><div class='comments'><article>I see</article></div>") == "The text of the post"
    assert _left("<nav>Home</nav><div class='builder-widget'>One part</div><div class='builder-widget'>Two part</div>") == "One part Two part"


def test_templates_of_small_and_large_hosts_and_copies_of_a_page(spark):
    page = "<body><div>{1}</div><p>The text of page {0} stands here</p></body>"
    menu, section = "Home Products About us", "Section news and sport"
    rows = [(i, "http://small.com/", page.format(i, menu)) for i in range(9)]
    rows += [(100 + i, "http://large.com/", page.format(i, section if i < 29 else f"Only here {i}, not elsewhere")) for i in range(100)]
    rows += [(300 + i, None, page.format("alone", "Its own introduction")) for i in range(12)]
    rows += [(400 + i, "http://copies.com/x", page.format("one", "Its own introduction")) for i in range(12)] + [(500 + i, "http://copies.com/y", page.format(i, f"Begin {i} of another")) for i in range(12)]
    rows += [(600 + i, "http://two.com/", page.format(i, menu)) for i in range(2)]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert len(got) == len(rows)
    assert got[3] == "The text of page 3 stands here" and got[105] == "The text of page 5 stands here"
    assert got[150] == "Only here 50, not elsewhere The text of page 50 stands here"
    assert got[300] == got[311] == "Its own introduction The text of page alone stands here"
    assert got[400] == got[411] == "Its own introduction The text of page one stands here"
    assert got[600] == f"{menu} The text of page 0 stands here"


def _luhn(s):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(s))) % 10 == 0


def test_pseudonyms_keep_formats_and_links(spark):
    text = "call +1 (743) 555-3824 or 743-555-3824, card 4041 8949 7460 8795 / 4041894974608796, ip 70.123.182.155 999.1.1.1, ssn 123-45-6789, born 1984-02-29 or 31.02.1990, a.Bc@x.co.uk."
    rows = [(1, text), (2, "4041894974608795 29/02/1984 A.bC@x.co.uk"), (3, None), (4, ""), (5, "nothing here"), (2, "4041894974608795 29/02/1984 A.bC@x.co.uk")]
    out = ps.pseudonymise(spark.createDataFrame(rows, "doc_id int, text string"), "k").collect()
    by = {r.doc_id: r for r in out}
    kinds = {k: [p.pseudonym for p in by[1].replaced if p.kind == k] for k in ("phone", "card", "ip", "ssn", "date", "email")}
    assert len(out) == 6 and by[3].text is None and by[3].replaced is None and by[4].text == "" and by[5].text == "nothing here" and by[5].replaced == []
    card = kinds["card"][0].replace(" ", "")
    assert len(kinds["card"]) == 1 and _luhn(card) and card != "4041894974608795" and card in by[2].text and "4041894974608796" in by[1].text and "999.1.1.1" in by[1].text
    assert kinds["phone"][0][-8:] == kinds["phone"][1][-8:] and kinds["phone"][0].startswith("+1 (")
    y, m, d = kinds["date"][0].split("-")
    assert f"{d}/{m}/{y}" in by[2].text and "31.02.1990" in by[1].text
    assert kinds["email"][0].endswith("@x.co.uk") and kinds["email"][0].swapcase().split("@")[0] != "a.bc" and not any(x in by[1].text for x in ("123-45-6789", "70.123.182.155", "a.Bc@"))


def test_permutations_are_permutations(spark):
    n = spark.range(0, 30 * 7).select(ps.permute_number(F.col("id"), 30, 7, "k", "t").alias("p"))
    assert sorted(r.p for r in n.collect()) == list(range(210))
    d = spark.range(0, 1000).select(ps.permute_text(F.lpad(F.col("id").cast("string"), 3, "0"), "k", "t").alias("p"))
    assert len({r.p for r in d.collect()}) == 1000


def test_pseudonyms_use_no_python(spark):
    plan = ps.pseudonymise(spark.createDataFrame([(1, "a@b.com")], "doc_id int, text string"), "k")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def _iban_ok(code):
    code = code.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def test_pseudonyms_of_account_numbers_dates_and_cards_after_marks(spark):
    rows = [(1, "pay DE89 3704 0044 0532 0130 00 or GB29NWBK60161331926819, not DE88 3704 0044 0532 0130 00."), (2, "DE89370400440532013000"), (3, "on 2020/01/31, 1/2/2020 and 01/02/2020, 31.1.2020"), (4, "No.4111 1111 1111 1111 and -4111111111111111 but 1.4111111111111111")]
    got = {r.doc_id: r for r in ps.pseudonymise(spark.createDataFrame(rows, "doc_id int, text string"), "k").collect()}
    ibans = [p.pseudonym for p in got[1].replaced]
    assert len(ibans) == 2 and all(_iban_ok(x) for x in ibans) and ibans[0][:2] == "DE" and ibans[0].replace(" ", "") == got[2].text != "DE89370400440532013000" and "DE88 3704 0044 0532 0130 00" in got[1].text
    assert [len(g) for g in ibans[0].split(" ")] == [4, 4, 4, 4, 4, 2]
    a, b, c, d = (p.pseudonym for p in got[3].replaced)
    day = lambda x: tuple(int(v) for v in x.split("/"))
    assert day(b) == day(c) and tuple(int(v) for v in reversed(d.split("."))) == day(a)
    cards = [p.pseudonym for p in got[4].replaced]
    assert len(cards) == 2 and cards[0].replace(" ", "") == cards[1] and _luhn(cards[1]) and got[4].text.endswith(" 1.4111111111111111")
    other = ps.pseudonymise(spark.createDataFrame(rows[1:2], "doc_id int, text string"), "another").first().text
    assert other != got[2].text and _iban_ok(other)


def test_url_rules_with_empty_labels_and_high_signs(spark):
    rules = [("com", "/en/", "block"), ("net", "/de/", "allow"), ("org", "/es/", "block"), ("a#b", "/", "block")]
    urls = ["http://en..com/x", "http://de..net/zz", "http://a.org/es/\U0010ffffz", "http://.com/en/", "http://com./en/", "http://com/en/#x", "http://..com/en/"]
    got = {r.url: (r.rule, r.verdict) for r in judge_urls(spark.createDataFrame([(u,) for u in urls], "url string"), spark.createDataFrame(rules, RULE_SCHEMA)).collect()}
    assert got == {u: _brute(u, rules[:3])[2:] for u in urls}
