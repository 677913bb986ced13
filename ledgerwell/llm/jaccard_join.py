"""N-gram Jaccard join: a size-aware heavy-light join over sets of word shingles.

Texts with equal sets form one class, so copies are compared once. Two different sets with Jaccard similarity t or more
share k shingles among the first n - ceil(t n) + k of each in any fixed order. Small sets enumerate the pairs of their
first shingles (subsets of size k = 2) and meet in equal pairs; large sets post their first shingles (k = 1) to inverted
lists, which are scanned. The boundary between small and large is the set size that makes the cost least. The order puts
rare shingles first, by a sketch of shingle counts over all texts; it sets the speed only.

A list is not expanded into all its pairs. Each class first checks one candidate, the leader it shares most lists with (a list's
leader is the class that has the list's shingle earliest, with the fewest shingles of its own before it); what this links
is one group. Only then the members of a list that are outside its leader's group are compared with the list's other
groups, block against block of similar sizes: a passage in many texts that aren't similar still costs a comparison for
each two of them that their sizes and places allow. So groups of near copies cost about one check a member, while every
link between two groups is found. Bitmaps of the sets rule out most candidates before their sets are fetched for the
exact test.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerwell.llm import wordhash as wh
from ledgerwell.llm.components import connected_components
from ledgerwell.llm.shared import free_name, join_small, table_cut

#: Cells of the count sketch and how many of them travel together. A power of two; more cells, fewer false "frequent".
SKETCH_CELLS, SKETCH_CHUNK = 1 << 22, 1 << 18
#: Sizes up to which sets may be small, and what a scanned list entry costs against an enumerated subset.
MOST_SMALL, SCAN_COST = 64, 3.0
#: Words of 64 bits in a set's bitmap: a set bit for each of its shingles' hashes.
BITMAP = 16
#: Rounds in which each class checks one leader before groups are compared.
LEADER_ROUNDS = 3
#: Rows in a block of a long list, and the ratio of sizes that one range of a list spans.
LIST_BLOCK, SIZE_RANGE = 2000, 1.1


def _prefix(n: int, num: int, den: int, k: int) -> int:
    """How many first shingles of n hold k of those shared with any similar set (at most n)."""
    return min(n, n - -(-num * n // den) + k)


def _sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The distinct shingles of each text, sorted."""
    hashes, counts = wh.words(*wh.text_bytes(column))
    for s in wh.shingles(hashes, counts, size):
        yield np.unique(s)


def _class_of(s: np.ndarray) -> int:
    """A set's hash as a signed 64-bit number."""
    with np.errstate(over="ignore"):
        return int(wh.mix(np.array([np.sum(s * (s | np.uint64(1))) ^ wh.mix(np.array([np.sum(wh.mix(s)) + np.uint64(len(s))], np.uint64))[0]], np.uint64))[0].astype(np.int64))


def _bitmap(s: np.ndarray) -> np.ndarray:
    bits = np.zeros(64 * BITMAP, np.uint8)
    bits[(s >> np.uint64(40)).astype(np.int64) % (64 * BITMAP)] = 1
    return np.packbits(bits).view(np.int64)


def _survey(docs: DataFrame, size: int) -> DataFrame:
    """One row a text (id, cls, n, bits) and the rows of each task's count sketch (chunk, cells), in one table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(SKETCH_CELLS, np.uint32)
        names = ["id", "cls", "n", "bits", "chunk", "cells"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int32(), pa.binary()]
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sets = list(_sets(part.column(1), size))
                every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                cells += np.bincount((every & np.uint64(SKETCH_CELLS - 1)).astype(np.int64), minlength=SKETCH_CELLS).astype(np.uint32)
                m = len(sets)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([_class_of(s) for s in sets], kinds[1]), pa.array([len(s) for s in sets], kinds[2]), pa.array([_bitmap(s) for s in sets], kinds[3]), pa.nulls(m, kinds[4]), pa.nulls(m, kinds[5])], names=names)
        for chunk in range(SKETCH_CELLS // SKETCH_CHUNK if cells.any() else 0):
            part = np.minimum(cells[chunk * SKETCH_CHUNK : (chunk + 1) * SKETCH_CHUNK], 65535).astype("<u2").tobytes()
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, k) for k in kinds[:4]), pa.array([chunk], kinds[4]), pa.array([part], kinds[5])], names=names)

    return docs.mapInArrow(run, "id long, cls long, n int, bits array<long>, chunk int, cells binary")


def _ranks(survey: DataFrame) -> bytes:
    """For each cell of the sketch how frequent its shingles may be, as 4 * log2 of the count: SKETCH_CELLS bytes."""

    def add(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in chunks:
            for chunk, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[chunk] = sums.get(chunk, 0) + np.frombuffer(cells, "<u2").astype(np.uint64)
        for chunk, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([(4 * np.log2(np.maximum(total, 1))).astype(np.uint8).tobytes()], pa.binary())], names=["chunk", "cells"])

    found = survey.filter("chunk is not null").select("chunk", "cells").repartition(SKETCH_CELLS // SKETCH_CHUNK, "chunk").mapInArrow(add, "chunk int, cells binary").collect()
    whole = np.zeros(SKETCH_CELLS, np.uint8)
    for r in found:
        whole[r["chunk"] * SKETCH_CHUNK : (r["chunk"] + 1) * SKETCH_CHUNK] = np.frombuffer(r["cells"], np.uint8)
    return whole.tobytes()


def _boundary(survey: DataFrame, num: int, den: int) -> int:
    """The size up to which sets are small: where enumerating their subsets costs less than scanning their lists."""
    sizes = dict(survey.filter(F.col("n").between(1, MOST_SMALL)).groupBy("n").count().collect())
    light = {n: c * comb(_prefix(n, num, den, 2), 2) for n, c in sizes.items()}
    heavy = {n: c * _prefix(n, num, den, 1) * SCAN_COST for n, c in sizes.items()}
    cost = {x: sum(v for n, v in light.items() if n <= x) + sum(v for n, v in heavy.items() if n * den >= x * num) for x in range(MOST_SMALL + 1)}
    return min(cost, key=lambda x: (cost[x], -x))


def _postings(docs: DataFrame, size: int, num: int, den: int, ranks: bytes, small: int) -> DataFrame:
    """(key, cls, n, pos): a row for each enumerated pair of a small set and for each posted shingle of a large one.

    pos is the place of the (first) shingle in the set's order: of a pair of sets whose first common shingle it is, at most
    n - pos shingles are common.
    Small sets so near the boundary that a large set can be similar post shingles too. Sets that only an equal set can
    be similar to have no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = np.frombuffer(sent.value, np.uint8)
        seen = set()  # classes that this task has posted
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                keys, owners, sizes, places = [], [], [], []
                for s in _sets(batch.column(0).slice(at, 1000), size):
                    n = len(s)
                    if num * (n + 1) > den * n and num * n > den * (n - 1):  # no set with one more or one less is similar
                        continue
                    cls = _class_of(s)
                    if (cls, n) in seen:
                        continue
                    seen.add((cls, n))
                    first = s[np.argsort(rank[(s & np.uint64(SKETCH_CELLS - 1)).astype(np.int64)], kind="stable")]
                    got, at_ = np.zeros(0, np.uint64), np.zeros(0, np.int64)
                    if n * den >= (small + 1) * num:
                        got = first[: _prefix(n, num, den, 1)]
                        at_ = np.arange(len(got))
                    if n <= small:
                        i, j = np.array(list(combinations(range(_prefix(n, num, den, 2)), 2)), np.int64).reshape(-1, 2).T
                        pairs = wh.mix(np.minimum(first[i], first[j]) * np.uint64(0x9E3779B97F4A7C15) + wh.mix(np.maximum(first[i], first[j])))
                        got, at_ = np.concatenate((got, pairs)), np.concatenate((at_, i))
                    keys.append(got)
                    places.append(at_.astype(np.int32))
                    owners.append(np.full(len(got), cls, np.int64))
                    sizes.append(np.full(len(got), n, np.int32))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(owners)), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(places))], names=["key", "cls", "n", "pos"])

    return docs.select("text").mapInArrow(run, "key long, cls long, n int, pos int")


def _sets_of(docs: DataFrame, size: int, wanted: DataFrame, rows: int) -> DataFrame:
    """(cls, n, s) of the wanted classes (cls, n, rep): the set of the text whose id is rep."""
    wanted = wanted.select(F.col("rep").alias("w_id"), F.col("cls").alias("w_cls"), F.col("n").alias("w_n"))
    texts = join_small(docs, wanted, docs["id"].eqNullSafe(F.col("w_id")), "inner", rows).select("text", "w_cls", "w_n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = {}
                for s, cls, n in zip(_sets(part.column(0), size), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    if (cls, n) not in seen and len(s) == n and _class_of(s) == cls:
                        found[cls, n] = s
                        seen.add((cls, n))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int32()), pa.array([s.view(np.int64) for s in found.values()], pa.list_(pa.int64()))], names=["cls", "n", "s"])

    return texts.mapInArrow(run, "cls long, n int, s array<long>")


def _plausible(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, an, b, bn) that their bitmaps don't rule out: similar sets differ in few shingles, so in few bits."""
    left = classes.select(F.col("cls").alias("a"), F.col("n").alias("an"), F.col("bits").alias("ba"))
    right = classes.select(F.col("cls").alias("b"), F.col("n").alias("bn"), F.col("bits").alias("bb"))
    differ = F.aggregate(F.zip_with("ba", "bb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, v: acc + v)
    return pairs.join(left, ["a", "an"]).join(right, ["b", "bn"]).filter((num + den) * differ <= (den - num) * (F.col("an") + F.col("bn"))).select("a", "an", "b", "bn")


def _similar(pairs: DataFrame, classes: DataFrame, docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """The pairs (a, an, b, bn) whose sets are similar: an exact test of every pair."""
    involved = pairs.select(F.col("a").alias("cls"), F.col("an").alias("n")).unionByName(pairs.select(F.col("b").alias("cls"), F.col("bn").alias("n"))).distinct()
    involved = table_cut(classes.select("cls", "n", "rep").join(involved, ["cls", "n"], "left_semi"), "shingle-involved")
    sets = table_cut(_sets_of(docs, size, involved, involved.count()), "shingle-sets")
    left = sets.select(F.col("cls").alias("a"), F.col("n").alias("an"), F.col("s").alias("sa"))
    right = sets.select(F.col("cls").alias("b"), F.col("n").alias("bn"), F.col("s").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(left, ["a", "an"]).join(right, ["b", "bn"]).filter(den * both >= num * (F.col("an") + F.col("bn") - both)).select("a", "an", "b", "bn")


def _lists(postings: DataFrame) -> DataFrame:
    """Postings of keys that more than one class has. Keys are summed up first, so no task holds a whole list."""
    postings = table_cut(postings, "shingle-postings")
    several = postings.groupBy("key").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi"), F.min("n").alias("n0"), F.max("n").alias("n1")).filter("lo <> hi or n0 <> n1").select("key")
    return postings.join(several, "key", "left_semi").distinct()


def _in_blocks(outside: DataFrame, others: DataFrame, num: int, den: int) -> DataFrame:
    """Rows of outside (key, a, an, a_pos, ..) with those of others (key, b, bn, ..) of the same list, where sizes and a's place allow it.

    Lists are cut by size ranges, and long ones into blocks of LIST_BLOCK rows that are joined block against block, so no
    task has a whole long list.
    """
    band = lambda n: F.floor(F.log(n.cast("double")) / F.lit(float(np.log(SIZE_RANGE)))).cast("int")
    least = F.greatest(F.ceil(num * F.col("an") / den), F.lit(1))
    most = F.least(F.floor(den * F.col("an") / num), F.floor((num + den) * (F.col("an") - F.col("a_pos")) / num) - F.col("an"))
    # a band more on either side, so that rounding loses nothing
    outside = outside.filter(most >= least).withColumn("band", F.explode(F.sequence(band(least) - 1, band(most) + 1)))
    others = others.withColumn("band", band(F.col("bn")))
    blocks = lambda df, name: df.groupBy("key", "band").agg(F.ceil(F.count("*") / LIST_BLOCK).alias(name))
    cuts = table_cut(blocks(outside, "a_blocks").join(blocks(others, "b_blocks"), ["key", "band"]), "list-blocks")
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = outside.join(cuts, ["key", "band"]).withColumn("a_block", F.pmod(F.xxhash64("a", "an"), F.col("a_blocks"))).withColumn("b_block", numbers("b_blocks")).drop("a_blocks", "b_blocks")
    right = others.join(cuts, ["key", "band"]).withColumn("b_block", F.pmod(F.xxhash64("b", "bn"), F.col("b_blocks"))).withColumn("a_block", numbers("a_blocks")).drop("a_blocks", "b_blocks")
    return left.join(right, ["key", "band", "a_block", "b_block"])


def similar_classes(docs: DataFrame, size: int = 5, threshold: tuple[int, int] = (80, 100)) -> tuple[DataFrame, DataFrame]:
    """(members, classes) for docs(id, text): members are (id, cls, n), classes are (cls, n, root_cls, root_n).

    cls and n name a class of equal shingle sets; classes lists those that are linked to a different class, each with
    the class that stands for its component. See near_duplicates for the meaning of links.
    """
    spark: SparkSession = docs.sparkSession
    num, den = threshold
    survey = table_cut(_survey(docs, size), "shingle-survey")
    members = survey.filter("chunk is null").select("id", "cls", "n", "bits")
    ranks, small = _ranks(survey), _boundary(members, num, den)
    lists = table_cut(_lists(_postings(docs, size, num, den, ranks, small)), "shingle-lists")
    reps = members.join(lists.select("cls", "n").distinct(), ["cls", "n"], "left_semi").groupBy("cls", "n").agg(F.min("id").alias("rep"), F.first("bits").alias("bits"))
    classes = table_cut(reps, "shingle-classes")

    def fits(an: str, bn: str, apos: str, bpos: str) -> Column:
        """Sizes and the places of a common shingle allow similarity."""
        an, bn, apos, bpos = (F.col(c) for c in (an, bn, apos, bpos))
        return (den * an >= num * bn) & (den * bn >= num * an) & ((num + den) * F.least(an - apos, bn - bpos) >= num * (an + bn))

    links, checked = None, None
    roots = None
    for turn in range(LEADER_ROUNDS + 1):
        marked = _marked(lists, roots)
        order = F.struct("pos", F.xxhash64("cls", "n", F.lit(turn)).alias("o"), "cls", "n", "root")
        heads = marked.groupBy("key").agg(F.min(order).alias("head"))
        open_rows = marked.join(heads, "key").filter(F.col("root") != F.col("head.root"))
        if turn < LEADER_ROUNDS:
            led = open_rows.filter(fits("n", "head.n", "pos", "head.pos")).select(F.col("cls").alias("a"), F.col("n").alias("an"), F.col("head.cls").alias("b"), F.col("head.n").alias("bn"))
            led = led.groupBy("a", "an", "b", "bn").count()
            pairs = led.groupBy("a", "an").agg(F.max_by(F.struct("b", "bn"), F.struct("count", "b", "bn")).alias("l")).select("a", "an", "l.b", "l.bn")
        else:
            outside = open_rows.select("key", F.col("cls").alias("a"), F.col("n").alias("an"), F.col("pos").alias("a_pos"), F.col("root").alias("a_root"), F.col("head.root").alias("h_root"))
            others = marked.select("key", F.col("cls").alias("b"), F.col("n").alias("bn"), F.col("pos").alias("b_pos"), F.col("root").alias("b_root"))
            once = (F.col("b_root") == F.col("h_root")) | (F.struct("a", "an") < F.struct("b", "bn"))
            pairs = _in_blocks(outside, others, num, den).filter((F.col("a_root") != F.col("b_root")) & once & fits("an", "bn", "a_pos", "b_pos")).select("a", "an", "b", "bn").distinct()
        lo, hi = F.least(F.struct(F.col("a").alias("c"), F.col("an").alias("m")), F.struct(F.col("b").alias("c"), F.col("bn").alias("m"))), F.greatest(F.struct(F.col("a").alias("c"), F.col("an").alias("m")), F.struct(F.col("b").alias("c"), F.col("bn").alias("m")))
        pairs = pairs.select(lo.alias("lo"), hi.alias("hi")).select(F.col("lo.c").alias("a"), F.col("lo.m").alias("an"), F.col("hi.c").alias("b"), F.col("hi.m").alias("bn")).distinct()
        pairs = table_cut(pairs if checked is None else pairs.join(checked, ["a", "an", "b", "bn"], "left_anti"), "shingle-pairs")
        checked = pairs if checked is None else checked.unionByName(pairs)
        likely = table_cut(_plausible(pairs, classes, num, den), "shingle-likely")
        if roots is not None and likely.isEmpty():
            continue
        found = table_cut(_similar(likely, classes, docs, size, num, den), "shingle-links")
        links = found if links is None else links.unionByName(found)
        node = lambda c, m: F.struct(F.col(c).alias("cls"), F.col(m).alias("n"))
        roots = table_cut(connected_components(links.select(node("a", "an").alias("a"), node("b", "bn").alias("b"))), "shingle-roots")
    return members.drop("bits"), roots.select("node.cls", "node.n", F.col("root.cls").alias("root_cls"), F.col("root.n").alias("root_n"))


def _marked(lists: DataFrame, roots: DataFrame | None) -> DataFrame:
    """lists with `root`, the class that stands for a class's group so far (itself at first)."""
    own = F.struct("cls", "n")
    if roots is None:
        return lists.withColumn("root", own)
    known = roots.select("node.cls", "node.n", F.col("root").alias("r"))
    return join_small(lists, known, ["cls", "n"]).select("key", "cls", "n", "pos", F.coalesce("r", own).alias("root"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """docs with one row of each component of near_duplicates; texts without words all stay.

    Rows are told apart by doc_id and text, so rows that repeat an id are judged by their own texts and rows that repeat
    both are one. Which row of a component stays is fixed by a hash of the two.
    """
    key = free_name(docs, "row_key")
    keyed = docs.withColumn(key, F.xxhash64(F.col(f"`{doc_id}`"), F.col(f"`{text}`")))
    found = near_duplicates(keyed.select(key, text), key, text, size, threshold)
    kept = table_cut(found.filter(F.col("doc_id") == F.col("component_id")).groupBy(F.col("doc_id").alias(key)).count(), "kept-rows")
    n, rows = kept.agg(F.count("*"), F.sum("count")).first()
    out = join_small(keyed, kept.select(key), key, "left_semi", n)
    return (out if rows in (None, n) else out.dropDuplicates([key])).drop(key)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """One row for each row of docs: (doc_id, n_shingles, component_id).

    Words are runs of non-white-space (ASCII) with A-Z lower-cased; a text's set holds its distinct runs of `size` words,
    or its whole sequence if that is shorter. Two texts are linked if den * intersection >= num * union. component_id is
    the smallest doc_id that can be reached. Null and empty texts have an empty set and are linked with nothing. A null
    doc_id counts above all others (a component of nulls only has a null id); rows that repeat a doc_id are compared by
    their own texts. An empty table gives an empty result. Links aren't listed one by one: groups of copies and near
    copies would make as many as the square of their sizes.
    """
    members, classes = similar_classes(docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")), size, threshold)
    least = members.filter("n > 0").groupBy("cls", "n").agg(F.min("id").alias("least"))
    joined = join_small(least, classes, ["cls", "n"]).select("cls", "n", "least", F.coalesce("root_cls", "cls").alias("root_cls"), F.coalesce("root_n", "n").alias("root_n"), F.col("root_cls").isNotNull().alias("linked"))
    tops = joined.filter("linked").groupBy("root_cls", "root_n").agg(F.min("least").alias("top"))
    component = join_small(joined, tops, ["root_cls", "root_n"]).select("cls", "n", F.coalesce("top", "least").alias("component"))
    out = members.join(component, ["cls", "n"], "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component")).alias("component_id"))
