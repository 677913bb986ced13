"""Benchmark decontamination: SimHash of item-sized windows, Hamming distances, exact weighted shingles.

A window of a text has as many words as a benchmark item. Only windows that hold a five-word shingle of an item of their
size are looked at, as any other has similarity 0 to all of them, and of these only windows without too many shingles of
no item. Windows and items get a 64-bit SimHash of their words. Every pair within the radius is then checked by the exact
weighted similarity of its shingles. A fingerprint counts words and the similarity distinct shingles, which fall apart
where shingles repeat; so windows and items that repeat a shingle are checked exactly whatever their fingerprints are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwell.llm import wordhash as wh
from ledgerwell.llm.shared import join_small, table_cut

SHINGLE, SIMILARITY = 5, 0.8
#: Fingerprints further apart than this aren't verified. Words changed at an end cost one shingle each, so at similarity 0.8
#: a tenth of the words may differ (a fifth where the missing shingles weigh little): 9 (13) bits on average, but the bits scatter.
RADIUS = 28
#: Pairs of fingerprints that are compared at once.
PAIRS_AT_ONCE = 1 << 20
#: Items, and bytes of their texts, in one pass over the documents at most; a larger benchmark takes several passes.
ITEMS_AT_ONCE, BYTES_AT_ONCE = 50_000, 1 << 25
#: Words of a text whose fingerprint sums are held at once.
STRETCH = 20_000
LEAKS = "array<struct<item_id:bigint,similarity:double,start:bigint,words:bigint>>"


@dataclass
class Items:
    """Benchmark items, grouped for lookup: all their shingles sorted, with the item and its words for each."""

    ids: list
    sizes: np.ndarray
    prints: np.ndarray
    sets: list[np.ndarray]
    keys: np.ndarray
    key_sizes: list[np.ndarray]
    weights: np.ndarray


def _bits(word_hashes: np.ndarray) -> np.ndarray:
    """+1 and -1 for the bits of each word's hash: (words, 64)."""
    return np.unpackbits(word_hashes.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1


def _pack(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1).view(np.uint64).reshape(-1)


def _shingles_of(texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, list[bytes]]:
    """(sets of shingles, word hashes, numbers of words, word sequences as bytes) of benchmark texts."""
    hashes, counts = wh.words(*wh.text_bytes(texts))
    sets = [np.unique(s) for s in wh.shingles(hashes, counts, SHINGLE)]
    return sets, hashes, counts, [x.tobytes() for x in np.split(hashes, np.cumsum(counts)[:-1])] if len(counts) else []


def prepare(ids: list, texts: list[str], shared: tuple[np.ndarray, np.ndarray] | None = None) -> Items:
    """Items with at least one word. A shingle's weight is 1 over the number of distinct item texts that have it.

    `shared`: sorted shingles that several texts of the whole benchmark have, and how many. If not given, the texts are
    the whole benchmark. Texts of the same words are one text.
    """
    sets, hashes, counts, sequences = _shingles_of(pa.array(texts, pa.string()))
    if shared is None:
        one_each = {x: sets[i] for i, x in enumerate(sequences)}
        shared = np.unique(np.concatenate(list(one_each.values())), return_counts=True) if one_each else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    ends = np.cumsum(counts)
    solid = [i for i, c in enumerate(counts) if c]
    prints = np.array([_pack(_bits(hashes[ends[i] - counts[i] : ends[i]]).sum(axis=0)[None, :])[0] for i in solid], np.uint64)
    every = np.concatenate([sets[i] for i in solid]) if solid else np.zeros(0, np.uint64)
    size_of = np.repeat([counts[i] for i in solid], [len(sets[i]) for i in solid]) if solid else np.zeros(0, np.int64)
    order = np.argsort(every, kind="stable")
    keys, first = np.unique(every[order], return_index=True)
    key_sizes = [np.unique(x) for x in np.split(size_of[order], first[1:])] if len(keys) else []
    n = np.ones(len(keys))
    if len(shared[0]):
        at = np.minimum(np.searchsorted(shared[0], keys), len(shared[0]) - 1)
        n = np.where(shared[0][at] == keys, shared[1][at], 1)
    return Items([ids[i] for i in solid], np.array([counts[i] for i in solid], np.int64), prints, [sets[i] for i in solid], keys, key_sizes, 1.0 / n)


def similarity(items: Items, window: np.ndarray, item: np.ndarray) -> float:
    """Weighted Jaccard similarity of a window's shingles and an item's.

    A shingle that isn't the item's weighs as much as those in both do on average, so an item whose passage stands in
    other items too is as near to a changed copy as one that stands alone.
    """
    both = np.isin(item, window, assume_unique=True)
    if not both.any():
        return 0.0
    weights = items.weights[np.searchsorted(items.keys, item)]
    common = weights[both].sum()
    return float(common / (weights.sum() + (len(window) - both.sum()) * common / both.sum()))


def _near(prints: np.ndarray, others: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs at most RADIUS bits apart. Every pair is compared: at this radius blocks of equal bits rule nothing out."""
    step = max(1, PAIRS_AT_ONCE // max(1, len(others)))
    for at in range(0, len(prints), step):
        near = np.bitwise_count(prints[at : at + step, None] ^ others[None, :]) <= RADIUS
        for i, j in np.argwhere(near).tolist():
            yield at + i, j


def _pairs(prints: np.ndarray, others: np.ndarray, loose: np.ndarray, loose_others: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs to be checked exactly: those near by their fingerprints, and all with a window or an item that repeats shingles."""
    firm, firm_others = np.flatnonzero(~loose), np.flatnonzero(~loose_others)
    for i, j in _near(prints[firm], others[firm_others]):
        yield int(firm[i]), int(firm_others[j])
    for i in np.flatnonzero(loose).tolist():
        for j in range(len(others)):
            yield i, j
    for j in np.flatnonzero(loose_others).tolist():
        for i in firm.tolist():
            yield i, j


def _possible(starts: np.ndarray, n: int, foreign: np.ndarray, again: np.ndarray) -> np.ndarray:
    """Those of the starts whose window of n words can be similar enough to an item.

    Similarity s takes at most (1 / s - 1) foreign shingles for each matched one. Runs of no item are foreign; only those
    that don't stand earlier in the window (`again`: how far back a run stands) are counted, and every other run as matched.
    """
    ends = np.minimum(starts + max(1, n - SHINGLE + 1), len(foreign))
    sums = np.concatenate(([0], np.cumsum(foreign & (again >= n))))
    known = np.concatenate(([0], np.cumsum(~foreign)))
    return starts[sums[ends] - sums[starts] <= (1 / SIMILARITY - 1) * (known[ends] - known[starts]) + 1e-9]


def _short_leaks(word_hashes: np.ndarray, items: Items) -> dict[int, tuple]:
    """Items of fewer than SHINGLE words, each at the first place where its words stand in a row."""
    best: dict[int, tuple] = {}
    for n in range(1, min(SHINGLE, len(word_hashes) + 1)):
        mine = np.flatnonzero(items.sizes == n)
        if len(mine):
            runs = wh.short_runs(word_hashes, n)
            wanted = np.array([items.sets[i][0] for i in mine], np.uint64)
            first: dict[int, int] = {}
            for p in np.flatnonzero(np.isin(runs, wanted)).tolist():
                first.setdefault(int(runs[p]), p)
            best.update({i: (-1.0, first[int(w)], n) for i, w in zip(mine.tolist(), wanted.tolist(), strict=True) if int(w) in first})
    return best


def leaks_of(word_hashes: np.ndarray, run: np.ndarray, items: Items) -> list[dict]:
    """Leaks in one text of given words and shingles: each item's most similar window, the first of equals."""
    m = len(word_hashes)
    if not m or not len(items.keys):
        return []
    best = _short_leaks(word_hashes, items)
    at = np.minimum(np.searchsorted(items.keys, run), len(items.keys) - 1)
    hits = np.flatnonzero(items.keys[at] == run) if m >= SHINGLE else np.zeros(0, np.int64)
    foreign = items.keys[at] != run
    order = np.argsort(run, kind="stable")
    again = np.full(len(run), m + 1, np.int64)
    same = run[order[1:]] == run[order[:-1]]
    again[order[1:][same]] = (order[1:] - order[:-1])[same]
    windows: dict[int, set[int]] = {}
    for p in hits.tolist():
        for n in items.key_sizes[at[p]].tolist():
            last = max(0, m - n)
            windows.setdefault(n, set()).update(range(max(0, min(last, p - max(0, n - SHINGLE))), min(p, last) + 1))
    for n, starts in windows.items():
        mine = np.flatnonzero(items.sizes == n)
        first = _possible(np.array(sorted(starts), np.int64), n, foreign, again)
        while len(first):
            upto = int(np.searchsorted(first, first[0] + STRETCH, "right"))
            part, first = first[:upto], first[upto:]
            lo, hi = int(part[0]), min(m, int(part[-1]) + n)
            sums = np.zeros((hi - lo + 1, 64), np.int32)
            np.cumsum(_bits(word_hashes[lo:hi]), axis=0, out=sums[1:])
            prints = _pack(sums[np.minimum(part + n, m) - lo] - sums[part - lo])
            k = max(1, n - SHINGLE + 1)
            repeats = np.concatenate(([0], np.cumsum(again < k)))
            ends = np.minimum(part + k, len(run))
            for w, k in _pairs(prints, items.prints[mine], repeats[ends] > repeats[part], np.array([len(items.sets[i]) < n - SHINGLE + 1 for i in mine])):
                start, item = int(part[w]), int(mine[k])
                window = np.unique(run[start : max(start + 1, min(start + n, m) - SHINGLE + 1)])
                s = similarity(items, window, items.sets[item])
                if s >= SIMILARITY - 1e-12 and (-s, start) < best.get(item, (1.0, 0))[:2]:
                    best[item] = (-s, start, min(n, m - start))
    return [{"item_id": items.ids[i], "similarity": -s, "start": start, "words": n} for i, (s, start, n) in sorted(best.items())]


def _search(sent):
    """Arrow function from texts to their leaks of the broadcast items."""

    def search(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("start", pa.int64()), ("words", pa.int64())]))
        for texts in column:
            results = []
            for at in range(0, len(texts), 1000):
                hashes, counts = wh.words(*wh.text_bytes(texts.slice(at, 1000)))
                start = 0
                for c, run in zip(counts.tolist(), wh.shingles(hashes, counts, SHINGLE), strict=True):
                    results.append(leaks_of(hashes[start : start + c], run, sent.value))
                    start += c
            yield pa.array(results, kind)

    return F.arrow_udf(search, LEAKS)


def _shared_shingles(texts: DataFrame) -> DataFrame:
    """(shingle, n): the shingles that several distinct texts have, over the whole table."""

    def cut(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([("words", pa.binary()), ("shingles", pa.list_(pa.int64()))])
        for part in column:
            sets, _, _, sequences = _shingles_of(part)
            yield pa.array([{"words": hashlib.blake2b(x, digest_size=16).digest(), "shingles": s.view(np.int64)} for x, s in zip(sequences, sets, strict=True)], kind)

    parts = texts.select(F.arrow_udf(cut, "struct<words:binary,shingles:array<bigint>>")("text").alias("p")).select("p.*").dropDuplicates(["words"])
    return parts.select(F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n")).filter("n > 1")


def find_leaks(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs with `leaks`: an array of (item_id, similarity, start, words), one for each benchmark item found in the text.

    Whole texts are searched, case (A-Z) and white space don't count. Null and empty texts have no leaks; items that are
    null or without words are never found; an item of fewer than five words is found wherever all its words stand in a
    row. Rows of items that repeat an id count as one item each. Either table may be empty; an input column called leaks
    is replaced, others may have any name. A benchmark beyond ITEMS_AT_ONCE or BYTES_AT_ONCE is taken in blocks, one on the
    driver and in a broadcast at a time, and what each finds is stored; shingles are weighed over the whole benchmark, so
    the blocks don't change a similarity.
    """
    spark = docs.sparkSession
    keep = [c for c in docs.columns if c.lower() != "leaks"]
    usable = items.select(F.col(f"`{item_id}`").cast("long").alias("item_id"), F.col(f"`{item_text}`").alias("text")).filter("text is not null").distinct()
    n, size = usable.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // ITEMS_AT_ONCE), -(-size // BYTES_AT_ONCE))
    shared = _shared_shingles(usable)
    if blocks == 1:
        sent = spark.sparkContext.broadcast(_block(usable, shared))
        return docs.select(*[F.col(f"`{c}`") for c in keep], _search(sent)(F.col(f"`{text}`")).alias("leaks"))
    shared, usable = table_cut(shared, "shared-shingles"), table_cut(usable, "benchmark-items")
    rows = table_cut(docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.monotonically_increasing_id().alias("uid")), "searched-rows")
    found = None
    for block in range(blocks):
        mine = usable.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        sent = spark.sparkContext.broadcast(_block(mine, shared))
        here = table_cut(rows.select("uid", _search(sent)(F.col("row")[text]).alias("l")).filter(F.size("l") > 0), "block-leaks")
        sent.destroy()
        found = here if found is None else found.unionByName(here)
    leaks = found.groupBy("uid").agg(F.array_sort(F.flatten(F.collect_list("l"))).alias("leaks"))
    out = join_small(rows, leaks, "uid")
    return out.select(*[F.col("row")[c].alias(c) for c in keep], F.coalesce("leaks", F.array().cast(LEAKS)).alias("leaks"))


def _block(items: DataFrame, shared: DataFrame) -> Items:
    """The items of one block on the driver, with the shingles of theirs that several texts of the whole benchmark have."""
    rows = items.orderBy("item_id", "text").collect()
    texts = [r["text"] for r in rows]
    here = np.unique(np.concatenate(_shingles_of(pa.array(texts, pa.string()))[0] or [np.zeros(0, np.uint64)])).view(np.int64)
    known = join_small(shared, items.sparkSession.createDataFrame(pa.table({"shingle": here})), "shingle", "left_semi", len(here)).toArrow()
    shingle, n = known["shingle"].to_numpy().view(np.uint64), known["n"].to_numpy()
    order = np.argsort(shingle)
    return prepare([r["item_id"] for r in rows], texts, (shingle[order], n[order]))
