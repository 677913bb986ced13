"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a token target. A target of t tokens over a source of s tokens takes every document floor(t / s) times
(complete epochs) and then draws documents without replacement for the rest: a document of quality weight w gets the key
-ln(u) / w, the smallest keys come first, and a prefix sum of sizes in key order stops at the budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerwell.llm.shared import join_small, table_cut

#: Keys of one source are dealt into ranges, so many for each doubling of the key; only the range in which the budget ends
#: is sorted. Keys spread over a few doublings, so a range holds about 0.3 % of a source's rows.
RANGES_PER_DOUBLING = 256


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row a source, null for rows without a source.

    Sources in code point order, null last, weigh `weights` in turn and share the sum of all sizes. A target stops at
    `most` times its source's size, and what it would exceed that by is shared by weight among the others until none is
    above. That is a water level: in the order of most * size / weight, the first sources are full, the rest get
    level * weight. The table has one row a source, so its one window is small.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * float(most))
    up = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, after = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy(F.lit(0)))
    level = F.greatest(F.lit(0.0), total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    s = s.withColumn("level", level)
    final = F.max("level").over(Window.partitionBy(F.lit(0)))  # it rises up to the first source that isn't full, then falls
    return s.select("source", "source_size", F.least(F.col("cap"), F.col("w") * final).alias("target"))


def mix_sources(df: DataFrame, source: str, size: Column, quality: Column, identity: list[str], weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, seed: int = 17) -> DataFrame:
    """df with size, source_size, target, copies (how often the mix takes the row) and taken (size times copies).

    `quality` is a row's weight in the fractional draw: null counts as 1, zero and less come after all others. The draw
    is a hash of `identity` (columns that tell rows apart) and `seed`, so a rerun gives the same mix; rows that agree in
    them share a key and are drawn together or not at all. Sizes are null-safe (null counts as 0), null sources
    form one source, an empty table gives an empty result, and input columns of these names are replaced.
    """
    made = ("size", "source_size", "target", "copies", "taken")
    keep = [c for c in df.columns if c.lower() not in made]
    u = (F.shiftrightunsigned(F.xxhash64(*[F.col(f"`{c}`") for c in identity], F.lit(seed)), 12).cast("double") + 0.5) / float(2**52)
    q = F.coalesce(quality.cast("double"), F.lit(1.0))
    key = F.when(q > 0, -F.log(u) / q).otherwise(F.lit(1e300) * (1 + u))
    # the caller's columns travel as one struct, so none of their names can clash with those made here
    words = F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)).cast("long").alias("size")
    ident = F.xxhash64(u, *[F.col(f"`{c}`") for c in identity]).alias("uid")
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), words, F.col(f"`{source}`").cast("string").alias("source"), ident)
    slim = table_cut(df.select(words, key.alias("key"), F.col(f"`{source}`").cast("string").alias("source"), ident), "mix-sizes")
    targets = source_targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    targets = table_cut(targets.withColumn("epochs", F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)) + 1e-12).cast("long")).withColumnRenamed("source", "t_source"), "mix-targets")
    n = targets.count()
    budgets = targets.select("t_source", (F.col("target") - F.col("epochs") * F.col("source_size")).alias("left"))
    drawn = _draw(slim.filter("size > 0"), budgets, n).withColumnsRenamed({"source": "d_source", "uid": "d_uid"})
    out = join_small(rows, targets, F.col("source").eqNullSafe(F.col("t_source")), rows=n)
    out = join_small(out, drawn, (F.col("uid") == F.col("d_uid")) & F.col("source").eqNullSafe(F.col("d_source")))
    copies = F.col("epochs") + F.col("d_uid").isNotNull().cast("long")
    return out.select(*[F.col("row")[c].alias(c) for c in keep], "size", "source_size", F.col("target").cast("double").alias("target"), copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def _draw(slim: DataFrame, budgets: DataFrame, n_sources: int) -> DataFrame:
    """(source, uid) of the documents drawn within each source's budget `left`.

    Documents come in key order as long as they fit; one that doesn't is passed over and later ones may fill the rest.
    Each round takes the longest prefix that fits of what can still fit (its first document always does), until nothing
    can: about one round for each halving of the budget, each over fewer rows than the one before.
    """
    key_range = F.floor(F.log2(F.greatest("key", F.lit(1e-300))) * RANGES_PER_DOUBLING).cast("int")
    slim = slim.groupBy("source", "uid").agg(F.sum("size").alias("size"), F.min("key").alias("key"))
    every = table_cut(join_small(slim, budgets, slim["source"].eqNullSafe(budgets["t_source"]), "inner", n_sources).drop("t_source").withColumn("r", key_range), "mix-keys")
    slim = every.filter("size <= left")
    drawn = None
    while True:
        sums = slim.groupBy(F.col("source").alias("s_source"), F.col("r").alias("s_r")).agg(F.sum("size").alias("range_size"))
        upto = Window.partitionBy("s_source").orderBy("s_r")
        sums = sums.withColumn("base", F.sum("range_size").over(upto) - F.col("range_size"))
        at = join_small(slim, sums, slim["source"].eqNullSafe(sums["s_source"]) & (slim["r"] == sums["s_r"]), "inner").drop("s_source", "s_r")
        whole = at.filter(F.col("base") + F.col("range_size") <= F.col("left"))
        edge = at.filter((F.col("base") + F.col("range_size") > F.col("left")) & (F.col("base") <= F.col("left")))
        inner = Window.partitionBy("source", "r").orderBy("key", "uid").rowsBetween(Window.unboundedPreceding, 0)
        edge = edge.withColumn("upto", F.col("base") + F.sum("size").over(inner))
        taken = table_cut(whole.select("source", "uid", "size").unionByName(edge.filter("upto <= left").select("source", "uid", "size")), "mix-taken")
        drawn = taken if drawn is None else drawn.unionByName(taken)
        used = taken.groupBy(F.col("source").alias("u_source")).agg(F.sum("size").alias("used"))
        rest = edge.filter("upto > left").drop("upto", "base", "range_size").unionByName(at.filter(F.col("base") > F.col("left")).drop("base", "range_size"))
        rest = join_small(rest, used, rest["source"].eqNullSafe(used["u_source"]), "left", n_sources).withColumn("left", F.col("left") - F.coalesce("used", F.lit(0))).filter("size <= left")
        slim = table_cut(rest.select("source", "uid", "key", "size", "left", "r"), "mix-rest")
        if slim.isEmpty():
            break
    # what is left of a budget is less than any document left: the one that comes nearest to it is taken if that makes the gap smaller
    used = drawn.groupBy(F.col("source").alias("u_source")).agg(F.sum("size").alias("used"))
    open_ = join_small(every, used, every["source"].eqNullSafe(used["u_source"]), "left", n_sources).withColumn("gap", F.col("left") - F.coalesce("used", F.lit(0))).filter("size < 2 * gap")
    taken = drawn.select(F.col("source").alias("d_source"), F.col("uid").alias("d_uid"))
    open_ = open_.join(taken, (F.col("uid") == F.col("d_uid")) & F.col("source").eqNullSafe(F.col("d_source")), "left_anti")
    last = open_.groupBy("source").agg(F.min_by("uid", F.struct(F.abs(F.col("size") - F.col("gap")), "key", "uid")).alias("uid"))
    return drawn.select("source", "uid").unionByName(last).distinct()
