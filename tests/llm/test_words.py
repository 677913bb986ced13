"""Runs of words, distances of sources and byte-pair encoding against plain versions of the same."""

import functools
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerwell.llm import bpe, divergence, queries, runs, shared

BPE_FILE = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_runs(words):
    out, n = [], len(words)
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j > i:
                length = j + p - i
                smaller = any(all(words[k] == words[k + q] for k in range(i, i + length - q)) for q in range(1, p))
                if length >= max(6, 4 * p) and not smaller:
                    out.append((i, length, p))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=12), st.integers(1, 7)), max_size=9))
def test_runs_of_repeated_pieces(pieces):
    words = [w for piece, times in pieces for w in piece * times]
    assert runs.find_runs(np.array(words, np.int64)) == plain_runs(words)


def test_runs_over_long_periods_and_random_words():
    rng = random.Random(4)
    for n, letters in ((300, 1), (300, 3), (450, 400), (400, 2)):
        words = [rng.randint(0, letters) for _ in range(n)]
        for p in (1, 2, 19, 29, 40, 55):
            a = rng.randrange(n - 5 * p)
            for i in range(a + p, a + 4 * p + rng.randrange(p)):
                words[i] = words[i - p]
        assert runs.find_runs(np.array(words, np.int64)) == plain_runs(words)
    assert runs.find_runs(np.zeros(100_000, np.int64)) == [(0, 100_000, 1)]
    words = np.arange(60_000) % 5
    words[30_000] = 9
    assert runs.find_runs(words) == [(0, 30_000, 5), (30_001, 29_999, 5)]


def plain_run_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = plain_runs(words)
    best = (None,) * 4
    if found:
        s, length, q = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]))
        best = s, length, q, 1000 * length // q
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    return doc_id, len(found), *best, sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(8)
    word = lambda: rng.choice(["la", "LA", "bär", "x y", "o1", "it's", "中文", "don't", "...", " ", "q\x1cr"]) + rng.choice(["", "", ".", "\n"])
    rows = [(i, " ".join(word() for _ in range(rng.randint(0, 90))), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None]), 1) for i in range(150)]
    rows += [(200, "a a a a a a a", "en", "a", 1), (201, "", "fr", "x", 1), (201, None, "fr", "y", None), (None, "q r s " * 30 + "\tq\v", None, None, 1), (202, "   \n", "", "a", 1)]
    rows += [rows[3], rows[3], (203, "<|endoftext|> a<|endoftext|>b 's'S \x85　 12١Ⅷx", "xx", "only", 1), (204, "ab" * 4000, "xx", "other", 1)]
    folder = str(tmp_path_factory.mktemp("words"))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], DOCS).write.parquet(f"{folder}/none/documents.parquet")
    return folder, rows


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def test_run_query(spark, corpus):
    folder, rows = corpus
    assert rows_of(queries.op11_word_runs(spark, folder)) == Counter(plain_run_row(r[0], r[1]) for r in rows)
    assert any(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows)
    assert queries.op11_word_runs(spark, f"{folder}/none").count() == 0


def test_columns_with_clashing_names(spark):
    df = spark.createDataFrame([("a a a a a a b", 1, 2, 3)], "Text string, PERIODIC int, tokens int, ids int")
    out = runs.word_runs(df).first()
    assert [tuple(r) for r in out["periodic_"]["runs"]] == [(0, 6, 1)] and out["periodic_"]["collapsed"] == "a b" and out["PERIODIC"] == 1
    out = bpe.round_trip(df, BPE_FILE).first()
    assert out["tokens_"]["decoded"] == "a a a a a a b" and (out["tokens"], out["ids"]) == (2, 3)


def test_bpe_query(spark, corpus):
    from tokenizers import Tokenizer

    folder, rows = corpus
    tok, want = Tokenizer.from_file(BPE_FILE), Counter()
    for r in rows:
        ids = tok.encode(r[1] or "", add_special_tokens=False).ids
        want[r[0], len(ids), sha(",".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))] += 1
    assert rows_of(queries.op13_bpe(spark, folder)) == want
    assert queries.op13_bpe(spark, f"{folder}/none").count() == 0


@functools.cache
def by_library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE_FILE)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("abcdeinorst '", max_size=200), st.lists(st.sampled_from(["the", "ing", " ", "  ", "\n", "'re", "==", "aaa", "<|endoftext|>", "é", "0", "-"])).map("".join)))
def test_bpe_equals_the_library(text):
    mine, library = bpe.load(BPE_FILE), by_library()
    ids = library.encode(text, add_special_tokens=False).ids
    assert mine.encode(text).tolist() == ids
    assert mine.decode(ids) == library.decode(ids, skip_special_tokens=False) == text


def test_bpe_of_long_pieces_and_broken_utf8():
    from tokenizers import Tokenizer

    mine, library = bpe.load(BPE_FILE), Tokenizer.from_file(BPE_FILE)
    for text in ("a" * 20_001, "=" * 9_999, " " * 5_000 + "x", "中" * 4_000, "thetheing" * 3_000):
        assert mine.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
    for ids in ([161], [160, 254, 50256, 161, 64], [158, 117, 242, 99]):
        assert mine.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_bpe_refuses_other_kinds_of_files():
    with pytest.raises(ValueError, match="byte-level"):
        bpe.ByteBpe(public_tokenizers.path("word_bpe_49k.json"))


def plain_divergence(rows, least):
    in_docs, counts, groups = Counter(), defaultdict(Counter), set()
    for _, text, lang, source, _ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        in_docs.update((lang, t) for t in set(terms))
        counts[lang, source].update(terms)
        counts[lang].update(terms)
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for (of, t), n in in_docs.items() if of == lang and n >= least]
        mine = sorted(s for of, s in groups if of == lang)

        def share(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p, q = {s: share(counts[lang, s]) for s in mine}, share(counts[lang])
        for s in mine:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in mine if o != s]
            terms = [(q[t] - p[s][t], t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            out |= {(lang, s, "pair", o, -v, k + 1) for k, (v, _, o) in enumerate(sorted(pairs))}
            out |= {(lang, s, "term", t, -v, k + 1) for k, (v, _, t) in enumerate(sorted(terms)[:3])}
    return out


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_source_divergence(spark, corpus, monkeypatch, broadcast):
    folder, rows = corpus
    monkeypatch.setattr(shared, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(divergence, "DEAL", 3)
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("term", F.lit(1)).withColumn("ITEM", F.lit(2))
    for least in (1, 30, 1000):
        out = divergence.source_divergence(docs, least_docs=least, top=3).collect()
        assert {tuple(r) for r in out} == plain_divergence(rows, least) and len(out) == len(plain_divergence(rows, least))
    assert divergence.source_divergence(spark.read.parquet(f"{folder}/none/documents.parquet")).count() == 0


def test_counting_in_small_portions(spark, corpus):
    folder, rows = corpus
    held, divergence.HELD_ENTRIES = divergence.HELD_ENTRIES, 5
    try:
        docs = spark.read.parquet(f"{folder}/documents.parquet").fillna("", ["text", "lang", "source"])
        counted = divergence.count_terms(docs).groupBy("lang", "term").agg(F.sum("n_docs").alias("d"), F.sum("n").alias("n")).filter("lang = 'en' and term = 'la'").first()
    finally:
        divergence.HELD_ENTRIES = held
    texts = [re.findall("(?i)[a-zä中文  ]+", r[1].replace("ä", "ä")) for r in rows if r[2] == "en"]
    assert counted["d"] == sum(any(t.lower() == "la" for t in x) for x in texts) and counted["n"] == sum(t.lower() == "la" for x in texts for t in x)
