"""Sharding by a k-d tree: nodes are split at distributed weighted medians along their widest metadata dimension.

Rows with equal texts go to one shard, unless a group weighs more than a quarter of a shard; such a group is dealt by row
into small pieces first. Groups and pieces are the points of the tree. Large whole groups would make its cuts uneven, so
they are placed first, the largest to the shard with the least so far, and the tree fills the shards up. It is built
level by level for all of its nodes at once: one aggregate finds each node's widest dimension, and a few histograms over
the digits of a 64-bit sort key find the weighted median in it. Only these bounded histograms and at most 64 large groups
a shard reach the driver, never rows.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerwell.llm.shared import join_small, table_cut

#: The most of a shard's target bytes that one group of equal texts may weigh and still stay whole.
WHOLE_GROUP = 1 / 4
#: Whole groups above this part of a shard are placed before the tree is built: at most so many a shard.
PLACED_GROUP = 1 / 64
#: Pieces that the rows of a heavier group are dealt to, for each shard (1024 at least); a piece counts by its own weight.
PIECES_PER_SHARD = 128
#: A sort key has 63 bits: a dimension's value scaled to its range on top, a hash below to tell equal values apart.
VALUE_BITS, KEY_BITS, DIGIT_BITS = 31, 62, 10
#: Buckets per shard in the numbering of slots.
SLOT_BUCKETS = 1024


@dataclass
class Node:
    """A node of the tree: the shards below it, and once it is split the dimension and the key that split it."""

    first: int
    shards: int
    dim: int = -1
    cut: int = 0


def kd_shards(df: DataFrame, group: list[str], weight: str, dims: list[Column], shards: int | None = None, target: int | None = None, whole: float = WHOLE_GROUP) -> DataFrame:
    """df with column `shard` (from 0), replacing one of that name.

    Give `shards`, or `target` bytes for a leaf (the shards are then total / target, rounded up). `weight` is a column
    of bytes (null counts as 0), `dims` are numeric metadata columns (null counts as the lowest value), `group` are the
    columns that equal texts share. Rows of a group stay together, nulls being equal, except in groups heavier than
    `whole` times a leaf (a quarter). An empty table gives an empty result; repeated rows are kept.
    """
    names = [c for c in df.columns if c.lower() != "shard"]
    keep = [F.col(f"`{c}`") for c in names]
    row_hash = F.xxhash64(*[c for c, x in zip(keep, names, strict=True) if df.schema[x].dataType.typeName() not in ("map", "variant")])
    sub = F.pmod(row_hash, F.lit(max(1024, PIECES_PER_SHARD * (shards or 0))))
    # the caller's columns travel as one struct, so none of their names can clash with those made here
    made = (
        F.struct(*keep).alias("row"), F.struct(*[F.xxhash64(*[F.col(f"`{c}`") for c in group], F.lit(i)).alias(f"h{i}") for i in (1, 2)]).alias("g"), sub.alias("sub"),
        F.coalesce(F.col(f"`{weight}`"), F.lit(0)).cast("long").alias("w"), F.array(*[F.coalesce(d.cast("double"), F.lit(float("-inf"))) for d in dims]).alias("d"),
    )
    rows = df.select(*made)
    parts = table_cut(rows.groupBy("g", "sub").agg(F.sum("w").alias("w"), F.min("d").alias("d")), "kd-groups")
    total = parts.agg(F.sum("w")).first()[0] or 0
    n = shards or max(1, -(-total // max(1, target or 1)))
    cap = max(1, int(total / n * whole))
    large = table_cut(parts.groupBy("g").agg(F.sum("w").alias("w"), F.count("*").alias("n")).filter(F.col("w") > min(cap, max(1, int(total / n * PLACED_GROUP)))), "kd-large")
    heavy = large.filter((F.col("w") > cap) & (F.col("n") > 1)).select("g", F.lit(True).alias("heavy"))  # at most n / whole groups
    whole_ones = large.filter((F.col("w") <= cap) | (F.col("n") == 1)).select("g", "w")  # at most n / PLACED_GROUP groups
    first, load = _place(whole_ones, int(n))
    piece = F.when(F.col("heavy"), F.col("sub") + 1).otherwise(F.lit(0)).cast("long").alias("piece")
    points = join_small(parts, heavy, "g").select("g", piece, "w", "d").groupBy("g", "piece").agg(F.sum("w").alias("weight"), F.min("d").alias("d"))
    points = points.withColumn("salt", F.shiftrightunsigned(F.xxhash64("g", "piece", F.lit("kd")), 64 - (KEY_BITS - VALUE_BITS)))
    points = join_small(points, first.select("g"), "g", "left_anti")
    placed = _grow(points, len(dims), load).select("g", "piece", "shard").unionByName(first)
    rows = join_small(rows.select("row", "g", "sub"), heavy, "g").select("row", "g", piece)
    return join_small(rows, placed, ["g", "piece"], "inner").select(*[F.col("row")[c].alias(c) for c in names], "shard")


def _place(groups: DataFrame, shards: int) -> tuple[DataFrame, list[int]]:
    """(g, piece, shard) of whole groups, largest first to the shard with the least so far, and what each shard then has."""
    rest = [(0, i) for i in range(shards)]
    out, load = [], [0] * shards
    for r in groups.orderBy(F.desc("w"), "g").collect():
        had, i = heapq.heappop(rest)
        out.append((tuple(r["g"]), 0, i))
        load[i] = had + r["w"]
        heapq.heappush(rest, (load[i], i))
    return groups.sparkSession.createDataFrame(out, "g struct<h1: bigint, h2: bigint>, piece bigint, shard int"), load


def _grow(points: DataFrame, n_dims: int, load: list[int]) -> DataFrame:
    """points with `shard`, so that with the load that they have all shards weigh alike.

    Each round splits every node with more than one shard, all in the same jobs.
    """
    shards = len(load)
    lo_hi = points.agg(*[f(F.when(F.col("d")[i] > float("-inf"), F.col("d")[i])).alias(f"{n}{i}") for i in range(n_dims) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    keys = []
    for i in range(n_dims):
        lo, hi = lo_hi[f"lo{i}"], lo_hi[f"hi{i}"]
        span = (hi - lo) if hi is not None and hi > lo else 1.0
        unit = F.greatest(F.lit(0.0), (F.col("d")[i] - F.lit(lo if lo is not None else 0.0)) / F.lit(span))
        value = F.least(F.floor(unit * (2**VALUE_BITS - 1)), F.lit(2**VALUE_BITS - 1)).cast("long")
        keys.append((F.shiftleft(value, KEY_BITS - VALUE_BITS) + F.col("salt")).alias(f"k{i}"))
    points = table_cut(points.select("g", "piece", "weight", *keys), "kd-points")
    nodes, leaves = [Node(0, shards)], {0: shards}
    node_of = F.lit(0)
    while any(n > 1 for n in leaves.values()):
        level = points.withColumn("node", node_of).filter(F.col("node").isin([k for k, n in leaves.items() if n > 1]))
        spans = level.groupBy("node").agg(*[(F.max(f"k{i}") - F.min(f"k{i}")).alias(f"s{i}") for i in range(n_dims)], F.sum("weight").alias("weight")).collect()
        wide = {r["node"]: max(range(n_dims), key=lambda i: r[f"s{i}"] >> (KEY_BITS - VALUE_BITS)) for r in spans}
        wanted = {}
        for r in spans:
            node, m = nodes[r["node"]], (leaves[r["node"]] + 1) // 2
            whole = r["weight"] + sum(load[node.first : node.first + node.shards])
            wanted[r["node"]] = min(r["weight"], max(0, whole * m / node.shards - sum(load[node.first : node.first + m])))
        cuts = _medians(level, wide, wanted)
        last = node_of
        for k in [k for k, n in leaves.items() if n > 1]:
            n = leaves.pop(k)
            node, left = nodes[k], (n + 1) // 2
            node.dim, node.cut = wide.get(k, 0), cuts.get(k, 0)
            for first, m in ((node.first, left), (node.first + left, n - left)):
                leaves[len(nodes)] = m
                nodes.append(Node(first, m))
            last = F.when(node_of == k, F.when(F.col(f"k{node.dim}") < node.cut, F.lit(len(nodes) - 2)).otherwise(F.lit(len(nodes) - 1))).otherwise(last)
        points = table_cut(points.withColumn("at", last), "kd-level") if "at" not in points.columns else table_cut(points.withColumn("next", last).drop("at").withColumnRenamed("next", "at"), "kd-level")
        node_of = F.col("at")
    shard_of = F.element_at(F.array(*[F.lit(n.first) for n in nodes]), node_of + 1)
    return points.withColumn("shard", shard_of)


def _medians(level: DataFrame, dim: dict[int, int], left: dict[int, float]) -> dict[int, int]:
    """For each node the key below which about `left` of its weight lies, digit by digit from the top.

    Every round sums weights by (node, digit) among the keys that share the digits found so far: at most 1024 sums a
    node. It ends when no node's open digit range holds more than a thousandth of its weight.
    """
    key = F.element_at(F.array(*[F.col(f"k{i}") for i in range(max(dim.values(), default=0) + 1)]), F.element_at(F.create_map(*[F.lit(x) for kv in dim.items() for x in (kv[0], kv[1] + 1)]), F.col("node"))) if dim else F.lit(0)
    level = level.select("node", "weight", key.alias("key"))
    known, below, open_weight = dict.fromkeys(dim, 0), dict.fromkeys(dim, 0.0), {}
    shift = KEY_BITS
    while shift > 0 and dim:
        step = min(DIGIT_BITS, shift)
        prefix = F.element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in (kv[0], kv[1])]), F.col("node"))
        here = level.filter(F.shiftright("key", shift) == prefix) if shift < KEY_BITS else level
        shift -= step
        sums = here.groupBy("node", F.shiftright("key", shift).alias("digit")).agg(F.sum("weight").alias("weight")).collect()
        for node in dim:
            mine = sorted((r["digit"], r["weight"]) for r in sums if r["node"] == node)
            at, acc = (known[node] << step), below[node]
            for digit, weight in mine:
                if acc + weight >= left[node]:
                    at, open_weight[node] = digit, weight
                    break
                at, acc, open_weight[node] = digit + 1, acc + weight, 0
            known[node], below[node] = at, acc
        if all(open_weight.get(node, 0) <= left[node] / 1000 for node in dim):
            break
    return {node: (known[node] + (below[node] + open_weight.get(node, 0) / 2 < left[node])) << shift for node in dim}


def number_rows(df: DataFrame, shard: str, order: list[str], name: str = "slot") -> DataFrame:
    """df with column `name` (replacing one of that name): 0, 1, ... in each shard. Rows are numbered in hash buckets of a shard, after the buckets before them."""
    names = [c for c in df.columns if c.lower() != name.lower()]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{shard}`").alias("shard"), F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in order]), F.lit(SLOT_BUCKETS)).alias("bucket"))
    counts = rows.groupBy("shard", "bucket").count()
    before = F.sum("count").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("shard", "bucket", F.coalesce(before, F.lit(0)).alias("base"))
    local = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy(*[F.col("row")[c] for c in order]))
    rows = join_small(rows.withColumn("local", local), bases, ["shard", "bucket"], "inner")
    return rows.select(*[F.col("row")[c].alias(c) for c in names], (F.col("base") + F.col("local") - 1).cast("long").alias(name))
