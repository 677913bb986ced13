"""Main text of web pages by site template removal.

Every page is parsed once by its task into blocks of text, each with the hashes of the element subtrees around it. Spark
counts on how many pages of a host each subtree occurs; a subtree on many pages of its host belongs to the site's
template and its blocks go, as do those in elements that never hold main text (menus, forms, adverts and so on).
What is left is joined in page order.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwell.llm.shared import free_name, join_small, table_cut
from ledgerwell.llm.url_rules import url_host

#: A subtree belongs to the template if it is on so many different pages of its host; of a small host half of the pages are
#: enough (but no less than LEAST_PAGES), of a large one it must be this share of them.
TEMPLATE_PAGES, LEAST_PAGES, SMALL_SHARE, LARGE_SHARE = 10, 3, 0.5, 0.01
#: Subtrees with fewer characters than this are too common to tell a template.
TEMPLATE_CHARS = 12

#: Elements whose content is no text of the page, and elements and class or id words that hold no main text.
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object")
#: Of these, elements that a tag may close at once.
FOREIGN = ("svg", "math")
ASIDE = ("head", "nav", "header", "footer", "aside", "form", "button", "select", "menu", "dialog")
#: Elements around the main text. Inside them only containers with less than half of it can belong to a template, never
#: paragraphs and the like: a passage that many articles share is still text.
MAIN = ("article", "main")
TEXT = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "li", "dt", "dd", "td", "th", "caption", "figcaption")
ASIDE_WORDS = (
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies",
    "disclaimer", "footer", "header", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "popup", "promo", "related", "share",
    "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
)
ASIDE_ROLES = ("navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "dialog", "alert")
#: Never without main text themselves, nor is an element around them.
NEVER_ASIDE = ("html", "body", *MAIN)
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
#: Elements that don't end a block.
INLINE = (
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp",
    "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img",
)

#: A tag's attributes: a quote opens a string only right after an equals sign. All possessive, so markup of any kind takes linear time.
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))*+)(?:>|\Z)", re.S)
_NAMED = re.compile(r"(?:^|[\s/])(class|id|role|style|hidden)(?![^\s=/])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_BASE, _PRIME = 0x9E3779B97F4A7C1, (1 << 61) - 1
_WORD = re.compile(r"[a-z0-9]+")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in RAW}
#: An opening tag that ends an open element of these kinds (their end tags may be left out).
_CLOSES = {"li": ("li",), "p": ("p",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


def _is_aside(tag: str, attributes: str) -> str:
    """What tells that an element holds no main text: "tag", "role", "hidden", "word" or nothing."""
    if tag in NEVER_ASIDE:
        return ""
    if tag in ASIDE:
        return "tag"
    found = ""
    for m in _NAMED.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or (name == "style" and _UNSEEN.search(value)):
            return "hidden"
        if name == "role" and value in ASIDE_ROLES:
            return "role"
        if name in ("class", "id") and any(w in ASIDE_WORDS for w in _WORD.findall(value)):
            found = "word"
    return found


class _Node:
    """An element: its blocks are those from `first` up to `last`, `above` is the next flagged or main element around it."""

    __slots__ = ("above", "aside", "first", "last", "main", "tag")

    def __init__(self, tag: str, aside: str, first: int, main: _Node | None, above: _Node | None) -> None:
        self.tag, self.aside, self.first, self.last, self.main, self.above = tag, aside, first, first, main, above


def _covered(nodes: list[_Node], n: int) -> list[bool]:
    """Which of n blocks are in one of the nodes."""
    steps = [0] * (n + 1)
    for node in nodes:
        steps[node.first] += 1
        steps[node.last] -= 1
    return [depth > 0 for depth in accumulate(steps[:n])]


def _clear_wrappers(nodes: list[_Node], sums: list[int]) -> None:
    """Take the flag from elements around the main text; where nothing would be left, from all that only words flag."""
    flagged = [node for node in nodes if node.aside and node.last > node.first]
    if not flagged:
        return
    total, chars = sums[-1], lambda node: sums[node.last] - sums[node.first]
    mains = [node for node in nodes if node.tag in NEVER_ASIDE and node.last > node.first]
    longest = max((chars(node) for node in mains if node.tag == "article"), default=0)
    # articles that are much shorter than the page's longest are comments, teasers and the like
    mains = [node for node in mains if node.tag != "article" or 2 * chars(node) >= longest]
    around_main: set[int] = set()
    for node in mains:
        up = node.above
        while up is not None and id(up) not in around_main:
            around_main.add(id(up))
            up = up.above
    for node in flagged:
        if id(node) in around_main:
            node.aside = ""
    # main elements in no flagged one; nodes come in page order, the outer before the inner
    in_aside: set[int] = set()
    in_main: set[int] = set()
    for node in nodes:
        up = node.above
        if up is not None and (up.aside or id(up) in in_aside):
            in_aside.add(id(node))
        if up is not None and (up.tag in MAIN or id(up) in in_main):
            in_main.add(id(node))
    free = [node for node in mains if node.tag in MAIN and id(node) not in in_aside]
    ends, starts = min((m.last for m in free), default=None), max((m.first for m in free), default=None)
    for node in flagged:
        if 2 * chars(node) > total and (node.tag not in ASIDE or node.tag == "form") and node.aside not in ("", "hidden"):
            # most of the page, unless the main text stands in its own element elsewhere
            apart = bool(free) and (ends <= node.first or starts >= node.last)
            if id(node) in in_main or not apart:
                node.aside = ""
    if all(_covered([node for node in flagged if node.aside], len(sums) - 1)):
        for node in flagged:
            if node.aside == "word":
                node.aside = ""


def parse_blocks(page: str, least_chars: int = TEMPLATE_CHARS) -> tuple[list[str], list[tuple[int, int, int]]]:
    """(blocks, subtrees) of a page: its blocks of text in order, without those in elements that hold no main text, and for
    each element that may belong to a template (hash, first block, block after its last).

    The text has character references decoded and white space collapsed. A subtree's hash covers its tag and the text of
    its blocks. Broken markup never fails: what isn't closed ends with the page. Time and memory are linear in the page:
    elements are ranges of blocks, and their hashes come from running sums.
    """
    root = _Node("", "", 0, None, None)
    stack, nodes, blocks, spans, buffer = [root], [], [], [], []
    open_tags: Counter[str] = Counter()

    def flush() -> None:
        text = " ".join(html.unescape("".join(buffer)).split())
        buffer.clear()
        if text:
            blocks.append(text)

    def close() -> None:
        node = stack.pop()
        open_tags[node.tag] -= 1
        node.last = len(blocks)
        if node.last > node.first and node.tag not in ("body", "html", *MAIN) and not (node.main and node.tag in TEXT):
            spans.append(node)

    at, n = 0, len(page)
    while at < n:
        m = _MARKUP.search(page, at)
        if not m:
            buffer.append(page[at:])
            break
        buffer.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag not in INLINE:
            flush()
        if m[1]:
            if open_tags[tag] > 0:
                while stack[-1].tag != tag:
                    close()
                close()
            continue
        if tag in VOID:
            continue
        if tag in _RAW_END:
            if tag in FOREIGN and m[3].endswith("/"):
                continue
            end = _RAW_END[tag].search(page, at)
            at = end.start() if end else n
            skip = _MARKUP.match(page, at) if end else None
            at = skip.end() if skip else at
            continue
        if tag in INLINE:
            continue
        for k in range(len(stack) - 1 if any(open_tags[c] > 0 for c in _CLOSES.get(tag, ())) else 0, 0, -1):
            if stack[k].tag in _CLOSES[tag]:
                while len(stack) > k:
                    close()
                break
            if stack[k].tag in ("ul", "ol", "dl", "table", "div", "article", "section", "select", "body"):
                break
        above = stack[-1]
        node = _Node(tag, _is_aside(tag, m[3]), len(blocks), above.main, above if above.aside or above.tag in MAIN else above.above)
        if node.aside or tag in NEVER_ASIDE:
            nodes.append(node)
        if node.main is None and tag in MAIN:
            node.main = node
        stack.append(node)
        open_tags[tag] += 1
    flush()
    while len(stack) > 1:
        close()
    sums = [0, *accumulate(len(text) for text in blocks)]
    _clear_wrappers(nodes, sums)
    gone = _covered([node for node in nodes if node.aside], len(blocks))
    # a polynomial of the blocks' hashes: that of a range is a difference of running ones
    power, running = [1], [0]
    for text in blocks:
        power.append(power[-1] * _BASE % _PRIME)
        running.append((running[-1] * _BASE + xxhash.xxh64_intdigest(text) % _PRIME) % _PRIME)
    places = [0, *accumulate(int(not g) for g in gone)]
    subtrees = []
    for node in spans:
        chars = sums[node.last] - sums[node.first]
        if chars >= least_chars and places[node.last] > places[node.first] and (node.main is None or 2 * chars < sums[node.main.last] - sums[node.main.first]):
            inside = (running[node.last] - running[node.first] * power[node.last - node.first]) % _PRIME
            h = xxhash.xxh64_intdigest(f"{node.tag} {node.last - node.first} {inside}") - (1 << 63)
            subtrees.append((h, places[node.first], places[node.last]))
    return [text for text, g in zip(blocks, gone, strict=True) if not g], subtrees


def main_text(pages: DataFrame, url: str = "url", html_column: str = "html", template_pages: int = TEMPLATE_PAGES, least_pages: int = LEAST_PAGES, least_chars: int = TEMPLATE_CHARS) -> DataFrame:
    """pages with `text` (main text, empty if none) and `n_chars` in place of the html column.

    Every page is parsed whole; null html is empty; pages without a host form one host. Repeated rows stay; pages of a
    host with the same text count once for its template; an empty table gives an empty result; input columns called text
    or n_chars are replaced, others may have any name. Text inside an element that holds no main text, or is hidden, goes
    even if it is on one page only. Elements around the main text or most of the page are never such, whatever their class,
    and if all text of a page would go, class and id words don't count. A subtree of `least_chars` characters or more is
    template if it is on `template_pages` different pages of its host; see TEMPLATE_PAGES for small and large hosts.
    """
    made = ("text", "n_chars", html_column.lower())
    keep = [c for c in pages.columns if c.lower() not in made]
    subtree_type = pa.struct([("h", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])

    def parse(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([("blocks", pa.list_(pa.string())), ("subtrees", pa.list_(subtree_type))])
        for texts in column:
            found = (parse_blocks(x.as_py() or "", least_chars) for x in texts)
            yield pa.array([{"blocks": b, "subtrees": [{"h": h, "first": i, "last": j} for h, i, j in t]} for b, t in found], kind)

    def strip(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for pages_, gone in columns:
            out = []
            for page, g in zip(pages_.to_pylist(), gone.to_pylist(), strict=True):
                if page is None:
                    out.append("")
                    continue
                bad, steps = set(g), [0] * (len(page["blocks"]) + 1)
                for t in page["subtrees"]:
                    if t["h"] in bad:
                        steps[t["first"]] += 1
                        steps[t["last"]] -= 1
                out.append(" ".join(b for b, depth in zip(page["blocks"], accumulate(steps), strict=False) if not depth))
            yield pa.array(out, pa.string())

    parsed_type = "struct<blocks:array<string>,subtrees:array<struct<h:bigint,first:int,last:int>>>"
    # the caller's columns travel as one struct, so none of their names can clash with those made here
    parsed = pages.select(F.struct(*[F.col(f"`{c}`") for c in keep], F.lit(None).cast("string").alias(free_name(pages, "none"))).alias("row"), F.monotonically_increasing_id().alias("uid"), url_host(F.col(f"`{url}`")).alias("host"), F.arrow_udf(parse, parsed_type)(F.col(f"`{html_column}`")).alias("page"))
    parsed = table_cut(parsed, "parsed-pages")
    # pages of the same text, such as repeated rows, count as one
    different = table_cut(parsed.groupBy("host", F.xxhash64("page.blocks").alias("text")).agg(F.min("uid").alias("uid")).select("uid", "host"), "different-pages")
    needed = F.greatest(F.lit(least_pages), F.least(F.lit(template_pages), F.ceil(SMALL_SHARE * F.col("n_pages"))), F.ceil(LARGE_SHARE * F.col("n_pages")))
    counted = parsed.select("uid", "host", F.array_distinct("page.subtrees.h").alias("subtrees")).join(different.select("uid"), "uid", "left_semi")
    subtrees = counted.select("host", F.explode("subtrees").alias("subtree")).groupBy("host", "subtree").count().filter(F.col("count") >= least_pages)
    sizes = different.groupBy("host").agg(F.count("*").alias("n_pages"))
    template = table_cut(subtrees.join(sizes, "host").filter(F.col("count") >= needed).select("host", "subtree"), "templates")
    # pages that have a block in a template subtree: few rows travel, those with the subtrees they have
    on_page = parsed.select("uid", "host", F.explode(F.array_distinct("page.subtrees.h")).alias("subtree"))
    on_page = join_small(on_page, template, ["host", "subtree"], "inner").groupBy("uid").agg(F.collect_set("subtree").alias("gone"))
    out = join_small(parsed, table_cut(on_page, "template-pages"), "uid")
    whole = F.coalesce(F.array_join("page.blocks", " "), F.lit(""))
    text = F.when(F.col("gone").isNull(), whole).otherwise(F.arrow_udf(strip, "string")(F.when(F.col("gone").isNotNull(), F.col("page")), F.coalesce("gone", F.array().cast("array<bigint>"))))
    return out.select("row", text.alias("text")).select(*[F.col("row")[c].alias(c) for c in keep], "text", F.char_length("text").cast("long").alias("n_chars"))
