"""Sharding, mixing, near duplicates, decontamination, token files, classifier, search and the pipeline."""

import collections
import os
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerwell.llm import decontaminate as dc
from ledgerwell.llm import jaccard_join as jj
from ledgerwell.llm import kd_shards as kd
from ledgerwell.llm import metric_tree as mt
from ledgerwell.llm import mixing, ordinal, token_files
from ledgerwell.llm import wordhash as wh
from ledgerwell.llm.components import connected_components

SF = "/root/testdata/sf0.001"


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def _prose(rng, n, words=400):
    return [f"w{rng.randrange(words)}" for _ in range(n)]


def test_word_hashes_see_words_only():
    h, n = wh.words(*wh.text_bytes(pa.array(["A b\tc", None, "", "a  b\u00a0c é", "a B c"])))
    assert n.tolist() == [3, 0, 0, 3, 3] and h[0] == h[3] and h[1] != h[4] and (h[:3] == h[-3:]).all()
    big, one = wh.words(*wh.text_bytes(pa.array(["x y " * 400_000])))[0], wh.words(*wh.text_bytes(pa.array(["x y"])))[0]
    assert len(big) == 800_000 and (big[::2] == one[0]).all() and (big[1::2] == one[1]).all()


def test_kd_shards_balance_bytes_and_keep_equal_texts(spark):
    rng = random.Random(1)
    rows = [(i, f"t{rng.randrange(900)}", rng.choice(["en", "de", None]), rng.random() * 10) for i in range(1500)] + [(5000 + i, "hot", "en", None) for i in range(600)] + [(None, None, None, None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, shard double").withColumn("w", F.length(F.coalesce("text", F.lit(""))).cast("long") + F.pmod(F.hash("text"), F.lit(90)))
    out = kd.kd_shards(df, ["text"], "w", [F.col("w"), F.xxhash64("lang") / 1e18], shards=5, whole=0.05)
    got = kd.number_rows(out, "shard", ["doc_id", "text"]).collect()
    size, where, slots = collections.Counter(), collections.defaultdict(set), collections.defaultdict(list)
    for r in got:
        size[r.shard] += r.w
        where[r.text].add(r.shard)
        slots[r.shard].append(r.slot)
    assert len(got) == len(rows) and set(size) == set(range(5)) and max(size.values()) < 1.08 * min(size.values())
    assert all(len(s) == 1 for t, s in where.items() if t != "hot") and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_kd_shards_keep_copies_whole_up_to_a_quarter_of_a_shard(spark):
    rng = random.Random(3)
    # copies of texts from a fiftieth to a quarter of a shard, many small texts, and one group of more than a shard
    rows = [(f"big{k}", 40) for k in range(14) for _ in range(rng.randrange(10, 120))] + [("hot", 40)] * 900 + [(f"t{k}", rng.randrange(1, 60)) for k in range(5000)]
    rows = [(i, t, w) for i, (t, w) in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string, w long")
    got = kd.kd_shards(df, ["text"], "w", [F.col("w"), F.xxhash64("text") / 1e18], shards=8).collect()
    size, where, of_text = collections.Counter(), collections.defaultdict(set), collections.Counter()
    for r in got:
        size[r.shard] += r.w
        of_text[r.text] += r.w
        where[r.text].add(r.shard)
    leaf = sum(size.values()) / 8
    assert len(got) == len(rows) and set(size) == set(range(8)) and max(size.values()) < 1.03 * leaf and min(size.values()) > 0.97 * leaf
    assert all(len(where[t]) == 1 for t, w in of_text.items() if w <= leaf / 4) and sum(leaf / 50 < w <= leaf / 4 for w in of_text.values()) >= 10


def test_kd_shards_of_empty_and_targets(spark):
    df = spark.createDataFrame([(1, "a", 10), (2, "b", 10), (3, "c", 10)], "doc_id long, text string, w long")
    assert {r.shard for r in kd.kd_shards(df, ["text"], "w", [F.col("doc_id")], target=10).collect()} == {0, 1, 2}
    assert kd.kd_shards(df.filter("false"), ["text"], "w", [F.col("doc_id")], shards=8).count() == 0


def _water(sizes, most=3.0):
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, target, open_ = float(sum(sizes.values())), {}, set(order)
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > most * sizes[s]}
        if not full:
            return target | share
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_mixing_meets_targets_and_repeats_itself(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", None, "tiny"] if i > 20 else ["tiny"]), rng.randrange(1, 60), rng.choice([None, 0.0, 0.5, 2.0])) for i in range(3000)] + [(9999, "b", None, 1.0), (9998, "b", 0, 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, source string, words long, q double")
    mix = lambda: {r.doc_id: r for r in mixing.mix_sources(df, "source", F.col("words"), F.col("q"), ["doc_id"]).collect()}
    got, again = mix(), mix()
    assert len(got) == len(rows) and {k: r.taken for k, r in got.items()} == {k: r.taken for k, r in again.items()}
    sizes = collections.Counter()
    for _, s, n, _ in rows:
        sizes[s] += n or 0
    want, taken = _water(sizes), collections.Counter()
    for r in got.values():
        taken[r.source] += r.taken
        assert r.taken <= 3 * r.size and r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
    assert all(abs(taken[s] - want[s]) <= 60 for s in sizes)
    assert mixing.mix_sources(df.filter("false"), "source", F.col("words"), F.col("q"), ["doc_id"]).count() == 0


def test_better_documents_are_drawn_more_often(spark):
    df = spark.range(0, 4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"), F.lit(10).alias("words"), F.when(F.col("id") % 4 < 2, 4.0).otherwise(1.0).alias("q"))
    r = mixing.mix_sources(df, "source", F.col("words"), F.col("q"), ["doc_id"]).filter("source = 'b'").groupBy("q").agg(F.avg("copies").alias("c")).collect()
    c = {x.q: x.c for x in r}
    assert c[4.0] > 1.5 * c[1.0]


def _components(rows):
    def shingles(t):
        w = (t or "").translate({i: i + 32 for i in range(65, 91)}).split()
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets = [(d, shingles(t)) for d, t in rows]
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min((x for x in (least.get(find(i)), d) if x is not None), default=None)
    return collections.Counter((d, len(s), least[find(i)] if s else d) for i, (d, s) in enumerate(sets))


def test_jaccard_components_match_brute_force(spark):
    rng = random.Random(3)
    rows = []
    shared = _prose(rng, 60)
    for _ in range(60):
        base = _prose(rng, rng.choice([1, 3, 4, 5, 8, 9, 12, 20, 40, 90, 300]))
        rows.append(base)
        for _ in range(rng.randrange(4)):
            copy = list(base)
            for _ in range(rng.randrange(3)):
                copy.insert(rng.randrange(len(copy) + 1), "x") if rng.random() < 0.5 else copy.pop(rng.randrange(len(copy))) if len(copy) > 1 else None
            rows.append(copy)
    hub = _prose(rng, 200)
    for k in range(40):  # a large group of near copies, and a passage in many texts
        rows.append([*hub[: 150 + k], *_prose(rng, 5)])
        rows.append([*_prose(rng, 150), *shared])
    docs = [(i, " ".join(r)) for i, r in enumerate(rows)] + [(900, None), (901, ""), (902, " \n"), (None, "a b c d e f"), (903, "A b c\td e f"), (904, "p q r s t u"), (904, "p q r s t u"), (905, docs0 := " ".join(hub)), (906, docs0.upper())]
    rng.shuffle(docs)
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in jj.near_duplicates(_docs(spark, docs)).collect())
    assert got == _components(docs)


def test_jaccard_prefixes_hold_what_similar_sets_share():
    for n in range(1, 80):
        for m in range(n, 100):
            if 100 * n < 80 * m:
                continue
            need = -(-80 * (n + m) // 180)
            if need <= n:
                assert n - jj._prefix(n, 80, 100, 1) < need and m - jj._prefix(m, 80, 100, 1) < need


def test_jaccard_of_a_passage_in_many_texts(spark, monkeypatch):
    rng = random.Random(31)
    passage = _prose(rng, 60, 9000)
    rows = [(i, " ".join([*passage, *_prose(rng, 10 + i % 23, 9000)])) for i in range(70)] + [(100 + i, " ".join([*passage[i % 5 :], "end"])) for i in range(10)]
    monkeypatch.setattr(jj, "LIST_BLOCK", 7)
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in jj.near_duplicates(_docs(spark, rows)).collect())
    assert got == _components(rows)
    outside = spark.createDataFrame([(1, i, 100, 0) for i in range(40)], "key long, a long, an int, a_pos int")
    others = spark.createDataFrame([(1, i, n) for i, n in enumerate([79, 80, 81, 100, 124, 125, 126, 300] * 5)], "key long, b long, bn int")
    met = jj._in_blocks(outside, others, 80, 100)
    pairs = [(r.a, r.b) for r in met.filter("bn between 80 and 125").collect()]
    assert len(pairs) == len(set(pairs)) == 40 * 25 and not met.filter("bn = 300").count()
    assert met.groupBy("band", "a_block", "b_block").count().agg(F.max("count")).first()[0] < 40 * 10


def test_near_duplicates_of_an_empty_table_and_one_stays(spark):
    assert jj.near_duplicates(_docs(spark, [])).count() == 0
    docs = _docs(spark, [(3, "a b c d e f"), (1, "A B c d e f"), (2, None), (2, None), (4, "")]).withColumn("row_key", F.lit("mine"))
    kept = jj.keep_one(docs).collect()
    assert sorted((r.doc_id if r.text is None or r.text == "" else 0) for r in kept) == [0, 2, 4] and {r.row_key for r in kept} == {"mine"}


def test_components_of_long_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60) if i % 10 != 9] + [(100, 100), (101, 102), (102, 101)], "a long, b long")
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert got == {i: i // 10 * 10 for i in range(60)} | {60: 60, 101: 101, 102: 101} or got == {i: i // 10 * 10 for i in range(60)} | {101: 101, 102: 101}


def test_leaks_are_found_and_clean_texts_left_alone(spark):
    rng = random.Random(4)
    item, other = _prose(rng, 40), _prose(rng, 15)
    near = [*item[:39], "changed"]
    rows = [(1, " ".join([*_prose(rng, 300, 9000), *item, *_prose(rng, 30, 9000)]).upper()), (2, " ".join(near)), (3, " ".join([*_prose(rng, 50, 9000), *item[:10], *_prose(rng, 50, 9000)])), (4, None), (5, ""), (6, "\n".join(other)), (7, " ".join(_prose(rng, 20000, 9000)) + " " + " ".join(item))]
    items = spark.createDataFrame([(0, " ".join(item)), (1, " ".join(other)), (2, None), (3, ""), (4, "two words")], "item_id long, text string")
    rows.append((8, "these are two words, TWO\nwords two words"))
    got = {r.doc_id: [(x.item_id, x.start, x.words) for x in r.leaks] for r in dc.find_leaks(_docs(spark, rows), items).collect()}
    assert got.pop(8) == [(4, 4, 2)]
    assert got == {1: [(0, 300, 40)], 2: [(0, 0, 40)], 3: [], 4: [], 5: [], 6: [(1, 0, 15)], 7: [(0, 20000, 40)]}
    assert dc.find_leaks(_docs(spark, []), items).count() == 0
    assert [r.leaks for r in dc.find_leaks(_docs(spark, rows[:1]), items.filter("false")).collect()] == [[]]


def _brute_leaks(texts, items):
    """Best similarity of each (text, item) by all windows; weights over the distinct texts of the items."""
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    of = collections.Counter(x for t in {" ".join(t.lower().split()) for _, t in items} for x in shingles(t.split()))
    out = {}
    for d, text in texts:
        w = text.lower().split()
        for i, t in items:
            mine, n = shingles(t.lower().split()), len(t.split())
            for p in range(max(1, len(w) - n + 1)):
                window = shingles(w[p : p + n])
                both = mine & window
                if both:
                    common = sum(1 / of[x] for x in both)
                    s = common / (sum(1 / of[x] for x in mine) + len(window - mine) * common / len(both))
                    if s >= 0.8 - 1e-9:
                        out[d, i] = max(s, out.get((d, i), 0))
    return {k: round(v, 9) for k, v in out.items()}


def test_leaks_of_items_that_repeat_a_passage(spark, monkeypatch):
    rng = random.Random(14)
    passage, other, tail = _prose(rng, 59, 9000), _prose(rng, 30, 9000), _prose(rng, 30, 9000)
    items = [(0, " ".join(passage)), (1, " ".join(passage).upper()), (2, "  ".join(passage)), (3, " ".join(other + tail)), (4, " ".join(passage[:40] + tail[:19])), (5, " ".join(tail))]
    changed = lambda w, at: " ".join([*_prose(rng, 20, 9000), *w[:at], "changed", *w[at + 1 :], *_prose(rng, 20, 9000)])
    texts = [(1, changed(passage, 30)), (2, changed(other + tail, 45)), (3, changed(tail, 29)), (4, changed(passage[:40] + tail[:19], 20)), (5, changed(passage[:30], 1))]
    want = _brute_leaks(texts, items)
    assert {(1, 0), (1, 1), (1, 2), (2, 3), (3, 5), (4, 4)} <= set(want) and want[1, 0] == want[1, 1] and not any(d == 5 for d, _ in want)
    table = spark.createDataFrame(items, "item_id long, text string")
    for at_once in (50_000, 3):
        monkeypatch.setattr(dc, "ITEMS_AT_ONCE", at_once)
        got = {(r.doc_id, x.item_id): round(x.similarity, 9) for r in dc.find_leaks(_docs(spark, texts), table).collect() for x in r.leaks}
        assert got == want, at_once


def _leaks_in(text, items):
    hashes, counts = wh.words(*wh.text_bytes(pa.array([text])))
    return {x["item_id"] for x in dc.leaks_of(hashes, next(wh.shingles(hashes, counts, dc.SHINGLE)), items)}


def test_passages_cut_at_an_end_are_found_like_brute_force():
    rng = random.Random(23)
    items, texts = [], []
    for n in (15, 23, 40, 50, 59):
        for _ in range(250):
            w = _prose(rng, n, 50_000)
            cut = rng.choice([k for k in range(1, n) if (n - 4 - k) >= 0.8 * (n - 4 + k)][-1:])
            items.append((len(items), " ".join(w)))
            texts.append((len(texts), " ".join([*_prose(rng, 9, 50_000), *w[: n - cut], *_prose(rng, cut + 9, 50_000)])))
    ready = dc.prepare(*map(list, zip(*items)))
    got = {(d, i) for d, t in texts for i in _leaks_in(t, ready)}
    want = {(d, i) for d, t in texts for d, i in _brute_leaks([(d, t)], [items[d]])}
    assert len(want) == len(texts) and got == want


def test_windows_left_out_early_are_never_similar():
    rng = random.Random(24)
    items = [(i, " ".join(_prose(rng, n, 4))) for i, n in enumerate([5, 8, 12, 15, 20, 30] * 3)]
    texts = [(d, " ".join([*_prose(rng, 3, 4), *items[d][1].split()[:-1], *_prose(rng, 4, 4), *["w1"] * 8])) for d in range(len(items))]
    ready = dc.prepare(*map(list, zip(*items)))
    assert {(d, i) for d, t in texts for i in _leaks_in(t, ready)} == set(_brute_leaks(texts, items))


def test_repeating_windows_and_items_are_found_like_brute_force():
    rng = random.Random(25)
    items, texts = [], []
    for k in range(200):
        w, r = _prose(rng, 16, 50_000), _prose(rng, 1, 50_000)
        # equal lengths, similarity 0.81, but very different counts of words
        items.append((k, " ".join(w + r * 53)))
        texts.append((k, " ".join(w * 4 + r * 5)))
    ready = dc.prepare(*map(list, zip(*items)))
    got = {(d, i) for d, t in texts for i in _leaks_in(t, ready)}
    assert got == {(d, i) for d, t in texts for d, i in _brute_leaks([(d, t)], [items[d]])} and len(got) == 200
    apart = [int(np.bitwise_count(dc.prepare([0], [t]).prints[0] ^ ready.prints[d])) for d, t in texts]
    assert max(apart) > dc.RADIUS  # fingerprints alone would lose some


def test_edited_passages_of_many_sizes_are_found_like_brute_force():
    rng = random.Random(26)
    items, texts = [], []
    for k in range(400):
        w = _prose(rng, rng.randint(5, 60), rng.choice([30, 50_000]))
        items.append((k, " ".join(w)))
        w = list(w)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(w))
            edit = rng.choice(["insert", "delete", "change", "repeat", "end"])
            if edit == "insert":
                w.insert(at, "new")
            elif edit == "delete" and len(w) > 1:
                del w[at]
            elif edit == "change":
                w[at] = "other"
            elif edit == "repeat":
                w[at:at] = w[max(0, at - 3) : at]
            else:
                w = w[: max(1, len(w) - 2)] + _prose(rng, 2, 50_000)
        texts.append((k, " ".join([*_prose(rng, 5, 50_000), *w, *_prose(rng, 5, 50_000)])))
    ready = dc.prepare(*map(list, zip(*items)))
    got = {(d, d) for d, t in texts if d in _leaks_in(t, ready)}
    of = {d: _brute_leaks([(d, t)], [items[d]]) for d, t in texts}
    # weights are those of all items, so shared shingles may weigh less than in this comparison of single pairs
    want = {p for d in of for p in of[d]}
    assert len(want) > 150 and len(want - got) <= len(want) // 100


def test_hamming_blocks_miss_nothing_within_the_radius():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2**64, 60, np.uint64), rng.integers(0, 2**64, 50, np.uint64)
    for i in range(50):
        b[i] = a[i] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(1, 30)).astype(np.uint64))
    want = {(i, j) for i in range(60) for j in range(50) if int(np.bitwise_count(a[i] ^ b[j])) <= dc.RADIUS}
    assert set(dc._near(a, b)) == want


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_token_files_round_trip(spark, name, tmp_path):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    texts = ["Hello, world!", None, "", "naïve ÉCOLE don't I'M x²", "a\tb\n\nc d\u3000e", "ΑΣ Σ 12,5 <|endoftext|>", "word " * 3000, "e\u0301a \u0301b"]
    rows = [(i * 3 % 8, t) for i, t in enumerate(texts)] + [(None, "null id"), (2, "again"), (2, "again")]
    folder = str(tmp_path / "tokens")
    got = sorted(token_files.token_table(_docs(spark, rows), "doc_id", "text", P.path(name), 1, folder).collect(), key=lambda r: r.start)
    tok, at = Tokenizer.from_file(P.path(name)), 0
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = collections.Counter()
    for d, t in order:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        want[d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want and [r.doc_id for r in got] == [d for d, _ in order]
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert any(f.endswith(".bin") for f in os.listdir(folder))
    assert token_files.token_table(_docs(spark, []), "doc_id", "text", P.path(name), 1).count() == 0


def test_classifier_ranks_held_out_documents(spark):
    rng = random.Random(6)
    docs, grades = [], []
    for i in range(1200):
        g = i % 3
        text = _prose(rng, 60) + ["awful"] * (g == 0) + ["| ***"] * (5 * (g < 2))
        rng.shuffle(text)
        docs.append((i, " ".join(text)))
        grades.append((i, g))
    d, g = _docs(spark, [*docs, (5000, None), (5001, "")]), spark.createDataFrame([*grades[:800], (None, 1), (3, None), (4, 7)], "doc_id long, grade int")
    model = ordinal.train(d, g)
    out = {r.doc_id: r for r in ordinal.score(d, model).collect()}
    held = [(out[i].expected_grade, g) for i, g in grades[800:]]
    assert len(out) == 1202 and np.mean([round(e) == g for e, g in held]) > 0.9 and (np.diff(model.thresholds) > 0).all()
    assert all(0 <= r.tail_probability <= 1 for r in out.values())
    empty = ordinal.train(d, g.filter("false"))
    assert abs(ordinal.score(d, empty).first().expected_grade - 1) < 0.4 and ordinal.score(d.filter("false"), model).count() == 0


def test_features_of_a_large_batch_take_little_memory_and_stay_the_same():
    rng = random.Random(3)
    texts = [" ".join(f"Word{rng.randrange(5000)}{rng.choice(['', ',', '!'])}" for _ in range(rng.randrange(900))) for _ in range(1500)] + ["", None, "one", ""]
    data, offsets = wh.text_bytes(pa.array(texts))
    assert len(data) > 5 * wh.BLOCK
    tracemalloc.start()
    together = [x.tobytes() for x in ordinal.features(data, offsets)]
    kept, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert together == [next(ordinal.features(*wh.text_bytes(pa.array([t], pa.string())))).tobytes() for t in texts]
    assert most - kept < 60 * wh.BLOCK  # whatever the batch has


def test_all_documents_are_kept_without_labels(spark):
    docs = _docs(spark, [(1, "a clean text of some words"), (2, None), (3, "")])
    kind = "doc_id long, quality int, toxic int"
    for rows in ([], [(9, 1, 0)], [(1, None, 0), (None, 1, 0)], [(2, 1, 0)]):
        assert [r.kept for r in ordinal.select_good(docs, spark.createDataFrame(rows, kind)).collect()] == [True] * 3, rows
    # one bad label tells too little
    assert all(r.kept for r in ordinal.select_good(docs, spark.createDataFrame([(1, 0, 1)], kind)).collect())


@pytest.mark.parametrize("labelled", [20, 39, 40, 87])
def test_few_labels(spark, labelled):
    rng = random.Random(labelled)
    good, bad = [f"word{k}" for k in range(400)], ["vile", "rotten", "nasty"]
    texts, grades = [], []
    for i in range(300):
        toxic = i % 4 == 1
        texts.append(" ".join(rng.choice(good) for _ in range(40)) + (" " + " ".join(bad) if toxic else ""))
        grades.append(int(toxic))
    docs = _docs(spark, list(enumerate(texts)))
    labels = spark.createDataFrame([(i, 1 - x, x) for i, x in enumerate(grades[:labelled])], "doc_id long, quality int, toxic int")
    kept = {r.doc_id: r.kept for r in ordinal.select_good(docs, labels).collect()}
    if labelled < ordinal.LEAST_LABELS:
        assert all(kept.values())
    else:
        held_out = range(labelled, 300)
        assert sum(kept[i] for i in held_out if not grades[i]) >= 0.98 * sum(not grades[i] for i in held_out)
        assert not any(kept[i] for i in held_out if grades[i])
    only_good = labels.filter("toxic = 0").unionByName(spark.createDataFrame([(i, 1, 0) for i in range(100, 200)], labels.schema))
    assert all(r.kept for r in ordinal.select_good(docs, only_good).collect())


def test_entries_of_the_fit_are_bounded_by_whole_rows(spark, monkeypatch):
    rows = [(i, " ".join(["same", f"w{i % 5}", "bad" if i % 3 == 0 else "fine"])) for i in range(120)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(120)], "doc_id long, quality int, toxic int")
    graded = labels.select("doc_id", (F.col("quality") + 1).alias("grade"))
    whole = ordinal.train(_docs(spark, rows), graded)
    monkeypatch.setattr(ordinal, "FIT_ENTRIES", 150)
    part = ordinal.train(_docs(spark, rows), graded)
    assert whole.rows == 120 and 0 < part.rows < 120


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(700, 8))
    x[100:300] = x[100]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (901, [1.0] * 7 + [None]), (902, [float("nan")] * 8), (903, [float("inf")] * 8), (None, [1.0] * 8), (904, [1.0] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("vec_id", mt.quantise(F.col("embedding")).alias("x"))
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in mt.top_k(df, df.filter("vec_id % 50 = 0"), 5).collect())
    q = np.floor(256 * x).astype(int)
    want = []
    for i in range(0, 700, 50):
        best = sorted((-int(q[i] @ q[j]), j) for j in range(700) if j != i)[:5]
        want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert got == sorted(want)
    few = df.filter("vec_id < 3")
    assert mt.top_k(few, few.filter("vec_id = 0"), 5).count() == 2 and mt.top_k(df.filter("false"), df, 5).count() == 0


def test_top_k_with_repeated_rows_and_a_longer_vector(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 4))
    ids = [*range(60), *[0] * 8]
    x = np.vstack([x, np.repeat(x[:1] * 3, 8, axis=0)])
    rows = [(i, [float(v) for v in r]) for i, r in zip(ids, x)] + [(100, [9.0] * 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("vec_id", mt.quantise(F.col("embedding")).alias("x"))
    one = df.filter("vec_id = 0").limit(1)
    q = np.floor(256 * x).astype(int)
    mine = np.array(one.first().x)
    want = sorted((-int(mine @ q[j]), j) for j in range(1, 60))[:5]
    got = sorted((r.rank, r.vec_id, r.score) for r in mt.top_k(df, one, 5).collect())
    assert got == [(k + 1, j, -s) for k, (s, j) in enumerate(want)]


def test_pipeline_stages_do_their_work(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("copies", F.lit(7)).withColumn("Bytes", F.lit("x"))
    names, now, before = docs.columns, docs, None
    for name, stage in cp.STAGES:
        out = cp.table_cut(stage(spark, now, SF), "test-stage")
        before, now = now, out
        assert [c for c in out.columns if c != "shard"] == names, name
        assert out.count() > 0
    assert [n for n, _ in cp.STAGES] == ["quality classifier", "n-gram jaccard join", "benchmark decontamination", "mixing sources", "sharding"]
    assert now.count() == before.count() and set(now.columns) - set(names) == {"shard"}
    for _, stage in cp.STAGES:
        assert stage(spark, docs.filter("false"), SF).count() == 0
