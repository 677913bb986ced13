"""How far apart the sources of a language are in their words: exact L1 distances of smoothed term frequencies.

The distance of two sources is a sum over the kept terms of their language. It starts from a baseline, the number of
terms times the difference of two zero counts; the inverted index (postings of term, source and count) then corrects it.
A posting's correction against sources without the term depends on its count alone, so those are emitted once a count
of a source, with the number of terms that have it; where two sources share a term, their postings meet on the term and
emit what is still missing, if that isn't zero. Terms that a source doesn't have cost nothing.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerwell.llm import shared
from ledgerwell.llm.shared import join_small, table_cut

SCALE, SMOOTHING = 1_000_000_000, 5
#: (group, term) entries that a task counts before it passes them on; they are added up afterwards.
HELD_ENTRIES = 300_000
#: Parts that a language's sources are dealt into where there are too many to broadcast.
DEAL = 64

#: Bytes outside of terms, as spaces; A to Z as a to z.
_BYTES = bytes((b | 32 if 65 <= b <= 90 else b) if b >= 128 or 65 <= b <= 90 or 97 <= b <= 122 else 32 for b in range(256))

COUNTED = "lang string, source string, term string, n long, n_docs long"


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, n_docs) partial counts of docs(lang, source, text), and a row without term for each group."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], dict[bytes, list[int]]] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            rows = [(lang, source, term and term.decode(), n, d) for (lang, source), terms in held.items() for term, (n, d) in terms.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), [pa.string()] * 3 + [pa.int64()] * 2, strict=True)], names=["lang", "source", "term", "n", "n_docs"])

        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                terms = held.setdefault((lang, source), {None: [0, 0]})
                size -= len(terms)
                for term, n in Counter(text.encode().translate(_BYTES).split()).items():
                    entry = terms.get(term)
                    if entry is None:
                        terms[term] = [n, 1]
                    else:
                        entry[0] += n
                        entry[1] += 1
                size += len(terms)
                if size >= HELD_ENTRIES:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return docs.select("lang", "source", "text").mapInArrow(count, COUNTED)


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + SMOOTHING) / (total + SMOOTHING * terms)), exact; null without terms."""
    over = ((n + SMOOTHING).cast("decimal(27,0)") * F.lit(SCALE).cast("decimal(10,0)")).cast("decimal(38,0)")
    under = (total + SMOOTHING * terms).cast("decimal(27,0)")
    return F.when(terms > 0, F.call_function("div", over, under) + 1)


def _others(left: DataFrame, groups: DataFrame, n_groups: int) -> DataFrame:
    """Each row of left(lang, source, ...) with every other source of its language, as groups(lang, item, ...) has it.

    Few groups are broadcast; more are dealt with a salt, so that one large language isn't one task.
    """
    on, kept = ["lang"], F.col("source") != F.col("item")
    if n_groups <= shared.BROADCAST_ROWS:
        return left.join(F.broadcast(groups), on).filter(kept)
    dealt = groups.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(DEAL - 1))))
    salted = left.withColumn("deal", F.pmod(F.xxhash64(*[c for c in left.columns if c != "lang"]), F.lit(DEAL)).cast("int"))
    return salted.join(dealt, [*on, "deal"]).filter(kept).drop("deal")


def source_divergence(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = 30, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank): distances of each source to the others of its language, and its terms.

    Terms are `[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`, A to Z lower-cased; a language keeps those in at least `least_docs`
    of its documents. Part `pair` has every other source and the sum over kept terms of the absolute difference of their
    shares; part `term` the `top` terms whose share is furthest above that of the language. Ranks go by value
    descending, then item. A null text, language or source is an empty one. A group without terms has its pairs, a
    language without kept terms pairs of 0; an empty table gives no rows. Repeated rows count as documents of their own;
    other columns don't matter.
    """
    text_of = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    counted = count_terms(docs.select(text_of(lang).alias("lang"), text_of(source).alias("source"), text_of(text).alias("text")))
    counted = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))
    by_term = Window.partitionBy("lang", "term")
    whole = counted.withColumn("total", F.sum("n").over(by_term)).withColumn("in_docs", F.sum("n_docs").over(by_term))
    index = table_cut(whole.filter(F.col("term").isNull() | (F.col("in_docs") >= least_docs)).select("lang", "source", "term", "n", "total"), "postings")

    langs = index.groupBy("lang").agg(F.countDistinct("term").alias("terms"), F.sum("n").alias("lang_total"))
    sums = index.groupBy("lang", "source").agg(F.sum("n").alias("group_total"))
    groups = join_small(sums, langs, "lang", "inner").withColumn("zero", _share(F.lit(0), F.col("group_total"), F.col("terms")))
    groups = table_cut(groups, "groups")
    n_groups = groups.count()
    postings = join_small(index.filter("term is not null"), groups, ["lang", "source"], "inner", n_groups)
    postings = postings.withColumn("p", _share(F.col("n"), F.col("group_total"), F.col("terms")))

    item = groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("item_zero"))
    gap = F.abs(F.col("zero") - F.col("item_zero"))
    base = _others(groups.select("lang", "source", "zero", "terms"), item, n_groups).select("lang", "source", "item", F.coalesce(F.col("terms") * gap, F.lit(0)).alias("value"))
    alike = postings.groupBy("lang", "source", "p", "zero").agg(F.count("*").alias("n_terms"))
    against_none = _others(alike, item, n_groups).select("lang", "source", "item", (F.col("n_terms") * (F.abs(F.col("p") - F.col("item_zero")) - gap)).alias("value")).filter("value != 0")
    mine = postings.select("lang", "term", "source", "p", "zero")
    theirs = mine.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("item_p"), F.col("zero").alias("item_zero"))
    both = F.abs(F.col("p") - F.col("item_p")) - F.abs(F.col("p") - F.col("item_zero")) - F.abs(F.col("zero") - F.col("item_p")) + gap
    shared = mine.join(theirs, ["lang", "term"]).filter("source < item").select("lang", "source", "item", both.alias("value")).filter("value != 0")
    shared = shared.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    one_way = against_none.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).unionByName(shared)
    swapped = one_way.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    pairs = base.unionByName(one_way).unionByName(swapped).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    ranks = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    q = _share(F.col("total"), F.col("lang_total"), F.col("terms"))
    terms = postings.select("lang", "source", F.col("term").alias("item"), (F.col("p") - q).alias("value")).filter("value > 0")
    terms = terms.withColumn("rank", F.row_number().over(ranks)).filter(F.col("rank") <= top)
    out = pairs.withColumn("rank", F.row_number().over(ranks)).withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term")))
    return out.select("lang", "source", "part", "item", "value", "rank")
