"""Exact top-k search by inner product with an M-tree: paged metric nodes, covering radii, stored parent distances.

Largest inner product becomes nearest neighbour by one more coordinate: a vector x gets sqrt(M^2 - |x|^2), a query 0,
with M the largest norm; then |q - x|^2 = |q|^2 + M^2 - 2 q.x. The upper nodes of the tree are regions around pivots, cut
into rings by the distance to the pivot and, where a ring is large, into pieces; each is a subtree that one task builds:
routing nodes with a centre, a covering radius and the distance to their parent's centre, down to leaf pages whose entries
keep their distances to the page's centre. A query first searches the nearest ring's subtree, then every one whose bound
isn't above its k-th distance: queries travel to subtrees. Inside, nodes are searched best first, and a distance is
computed only where the triangle inequality over the stored ones doesn't rule the node or entry out.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerwell.llm.shared import join_small, table_cut

#: Pivots (a bounded sample) and the most rings around one, vectors in a subtree, children of a node and entries of a
#: leaf page, queries that share one copy of a subtree.
PIVOTS, RINGS, SUBTREE, FAN, PAGE, QUERY_BLOCK = 32, 64, 20_000, 32, 1024, 4_000
#: Bounds are widened by these shares of the distance and of the norms, far more than doubles can be off.
SLACK, NORM_SLACK = 1e-6, 1e-7
LONGS = np.iinfo(np.int64)
TREE = ["region", "ring", "piece"]
NODES = "region int, ring int, piece long, node int, parent int, centre binary, parent_d double, radius double, ids binary, entries binary, entry_d binary"
FOUND = "query_id long, q long, vec_id long, score long"


def quantise(embedding):
    """floor(256 * x) of every component as long; null for a vector that is null or has a null or non-finite component."""
    x = F.transform(embedding, lambda v: v.cast("double"))
    ok = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(F.coalesce(ok, F.lit(False)), F.transform(x, lambda v: F.floor(v * 256).cast("long")))


def _matrix(column, kind=np.float64) -> np.ndarray:
    return np.array(list(column), dtype=np.int64).reshape(len(column), -1).astype(kind, copy=False)


def _lift(x: np.ndarray, m2: float) -> np.ndarray:
    x = x.astype(np.float64)
    return np.hstack([x, np.sqrt(np.maximum(m2 - (x * x).sum(axis=1), 0))[:, None]])


def _dist(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T, 0))


def _most(x: np.ndarray) -> float:
    return float(np.abs(x.astype(np.float64)).max(initial=0))


def _scores(entries: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products; those beyond the range of a long count as its ends."""
    exact = entries.astype(object) @ x.astype(object) if len(x) else np.zeros(len(entries), object)
    return np.array([min(max(int(s), LONGS.min), LONGS.max) for s in exact], np.int64)


def build_tree(group: pd.DataFrame, m2: float) -> pd.DataFrame:
    """The nodes of one subtree. Node 0 is its root; a node with entries is a leaf page of at most PAGE of them."""
    x, ids = _matrix(group["x"], np.int64), group["vec_id"].to_numpy()
    up, out = _lift(x, m2), []
    todo = [(np.argsort(ids, kind="stable"), -1, None)]
    while todo:
        member, parent, above = todo.pop()
        centre = up[member].mean(axis=0)
        d = np.sqrt(((up[member] - centre) ** 2).sum(axis=1))
        node = {"node": len(out), "parent": parent, "centre": centre.tobytes(), "parent_d": 0.0 if above is None else float(np.linalg.norm(centre - above)), "radius": float(d.max()), "ids": None, "entries": None, "entry_d": None}
        out.append(node)
        if len(member) <= PAGE:
            node |= {"ids": ids[member].astype("<i8").tobytes(), "entries": x[member].astype("<i8").tobytes(), "entry_d": d.astype("<f8").tobytes()}
            continue
        n = min(FAN, -(-2 * len(member) // PAGE))
        seeds = up[member[:: max(1, len(member) // n)][:n]]
        nearest = np.concatenate([_dist(up[member[i : i + 4096]], seeds).argmin(axis=1) for i in range(0, len(member), 4096)])
        parts = [member[nearest == c] for c in np.unique(nearest)]
        if len(parts) == 1:  # equal vectors
            parts = np.array_split(member, n)
        todo.extend((p, node["node"], centre) for p in parts)
    return pd.DataFrame(out)


def search_tree(nodes: pd.DataFrame, queries: pd.DataFrame, m2: float, k: int) -> pd.DataFrame:
    """The k best entries of one subtree for each query, best node first; ties go to the smaller id."""
    out: list[tuple] = []
    if len(nodes) and len(queries):
        nodes = nodes.sort_values("node")
        centres = np.stack([np.frombuffer(b) for b in nodes["centre"]])
        parent, parent_d, radius = nodes["parent"].to_numpy(), nodes["parent_d"].to_numpy(), nodes["radius"].to_numpy()
        dim = centres.shape[1] - 1
        leaf = [None if i is None else (np.frombuffer(i, "<i8"), np.frombuffer(e, "<i8").reshape(-1, dim) if dim else np.zeros((len(i) // 8, 0), np.int64), np.frombuffer(d, "<f8")) for i, e, d in zip(nodes["ids"], nodes["entries"], nodes["entry_d"], strict=True)]
        # doubles hold all products and sums exactly as long as these are below 2^52
        quick = [None if leaf_ is None else (leaf_[1].astype(np.float64), _most(leaf_[1]) * max(1, dim)) for leaf_ in leaf]
        below = {p: np.flatnonzero(parent == p) for p in np.unique(parent) if p >= 0}
        for q_id, q_row, x, known in zip(queries["query_id"].tolist(), queries["q"].tolist(), _matrix(queries["x"], np.int64), queries["score"].tolist(), strict=True):
            q = np.append(x.astype(np.float64), 0.0)
            norm = float(q @ q)
            wide = NORM_SLACK * (np.sqrt(norm) + np.sqrt(m2)) + 1e-9
            reach_of = lambda score: np.sqrt(max(norm + m2 - 2 * float(score), 0)) * (1 + SLACK) + wide  # noqa: E731, B023
            x_quick, x_most = x.astype(np.float64), _most(x)
            reach = np.inf if known is None or known != known else reach_of(known)
            d_root = float(np.linalg.norm(q - centres[0]))
            heap, best = [(max(d_root - radius[0], 0.0), 0, d_root)], []  # best: a heap of (score, -id)
            while heap:
                bound, node, d = heapq.heappop(heap)
                if bound > reach:
                    break
                if leaf[node] is None:
                    near = below[node]
                    near = near[np.abs(d - parent_d[near]) - radius[near] <= reach]
                    to = np.sqrt(((centres[near] - q) ** 2).sum(axis=1))
                    for b, c, dc in zip(np.maximum(to - radius[near], 0).tolist(), near.tolist(), to.tolist(), strict=True):
                        if b <= reach:
                            heapq.heappush(heap, (b, c, dc))
                    continue
                ids, entries, entry_d = leaf[node]
                some = np.flatnonzero((np.abs(d - entry_d) <= reach) & (ids != q_id))
                numbers, most = quick[node]
                near = numbers if len(some) == len(ids) else numbers[some]
                scores = near @ x_quick if most * x_most < 2.0**52 else _scores(entries[some], x)
                if len(best) == k:
                    good = scores >= best[0][0]
                    some, scores = some[good], scores[good]
                for i in np.lexsort((ids[some], -scores))[:k]:
                    pair = (int(scores[i]), -int(ids[some[i]]))
                    if len(best) < k:
                        heapq.heappush(best, pair)
                    elif pair > best[0]:
                        heapq.heapreplace(best, pair)
                if len(best) == k:
                    reach = min(reach, reach_of(best[0][0]))
            out.extend((q_id, q_row, -minus, score) for score, minus in best)
    return pd.DataFrame(out, columns=["query_id", "q", "vec_id", "score"]).astype("int64")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k vectors with the highest integer inner product.

    Both have (vec_id, x) with x from quantise. Vectors with null x or null id take no part. A query is compared with the
    vectors of its own length; vectors of other lengths are no candidates. A vector isn't a candidate for queries of its
    own id. Ties go to the smaller vec_id; rows that repeat an id are candidates one each, queries that repeat an id with
    another vector get a ranking each, and queries that repeat both one. Scores beyond the range of a long count as its
    ends. With fewer than k candidates all are returned, and an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    clean = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), "x").filter("vec_id is not null and x is not null")
    vectors, queries = clean(vectors), clean(queries).select(F.col("vec_id").alias("query_id"), F.xxhash64("x").alias("q"), "x").distinct()
    # of equal vectors only those of the k + 1 smallest ids can be among a query's k best, and k of each id
    vectors = vectors.withColumn("r", F.dense_rank().over(Window.partitionBy("x").orderBy("vec_id"))).filter(F.col("r") <= k + 1)
    vectors = table_cut(vectors.withColumn("r", F.row_number().over(Window.partitionBy("x", "vec_id").orderBy("r"))).filter(F.col("r") <= k).drop("r"), "vectors")
    usual = vectors.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    if usual is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim = usual["dim"]
    norm2 = F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    m2 = float(vectors.agg(F.max(norm2)).first()[0] or 0) * (1 + 1e-12)
    pivots = _lift(_matrix([r["x"] for r in vectors.filter(F.size("x") == dim).orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).collect()]), m2)

    def to_pivots(x: pd.Series, lift: bool) -> list[tuple[list[int], list[float]]]:
        """Regions and distances to their pivots. Vectors of another than the usual length have a region each length, around 0."""
        out: list = [None] * len(x)
        usual_ = np.flatnonzero([len(v) == dim for v in x])
        if len(usual_):
            a = _matrix(x.iloc[usual_])
            d = _dist(_lift(a, m2) if lift else np.hstack([a, np.zeros((len(a), 1))]), pivots)
            for i, row in zip(usual_.tolist(), d, strict=True):
                out[i] = (list(range(len(pivots))), row.tolist())
        for i in (i for i, v in enumerate(out) if v is None):
            v = np.asarray(x.iloc[i], np.float64)
            out[i] = ([-1 - len(v)], [float(np.sqrt(m2) if lift else np.sqrt(v @ v))])
        return out

    @F.pandas_udf("struct<region:int,d:double>")
    def region(x: pd.Series) -> pd.DataFrame:
        found = [(r[int(np.argmin(d))], min(d)) for r, d in to_pivots(x, True)]
        return pd.DataFrame(found, columns=["region", "d"]).astype({"region": "int32", "d": "float64"})

    @F.pandas_udf("array<struct<d:double,region:int>>")
    def routes(x: pd.Series) -> pd.Series:
        return pd.Series([[{"d": b, "region": a} for a, b in zip(r, d, strict=True)] for r, d in to_pivots(x, False)], dtype=object)

    dealt = table_cut(vectors.withColumn("p", region("x")).select("vec_id", "x", "p.*"), "regions")
    cuts = dealt.groupBy("region").agg(F.count("*").alias("n"), F.percentile_approx("d", [i / RINGS for i in range(1, RINGS)], 1000).alias("cuts"))
    cuts = cuts.select("region", "cuts", F.least(F.lit(RINGS), F.ceil(F.col("n") / SUBTREE)).cast("int").alias("rings"))
    ring = F.floor(F.size(F.filter("cuts", lambda c: c < F.col("d"))) * F.col("rings") / RINGS).cast("int")
    dealt = join_small(dealt, cuts, "region").select("vec_id", "x", "d", "region", ring.alias("ring"))
    rings = table_cut(dealt.groupBy("region", "ring").agg(F.ceil(F.count("*") / SUBTREE).alias("pieces"), F.min("d").alias("lo"), F.max("d").alias("hi")), "rings")
    n_rings = rings.count()
    dealt = join_small(dealt, rings.select("region", "ring", "pieces"), ["region", "ring"], rows=n_rings).withColumn("piece", F.pmod(F.xxhash64("x", "vec_id"), F.col("pieces")))

    def build(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return build_tree(group, m2).assign(**dict(zip(TREE, key, strict=True)))

    nodes = table_cut(dealt.select(*TREE, "vec_id", "x").groupBy(*TREE).applyInPandas(build, NODES), "tree-nodes")
    trees = rings.select("region", "ring", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece"), "lo", "hi")
    asked = table_cut(queries.withColumn("to", routes("x")), "queries")
    wide = NORM_SLACK * (F.sqrt(norm2) + F.lit(float(np.sqrt(m2)))) + 1e-9
    bound = F.greatest(F.col("t.d") - F.col("hi"), F.col("lo") - F.col("t.d"), F.lit(0.0))

    def visit(to: DataFrame) -> DataFrame:
        """Search the subtrees that queries are sent to; a subtree is copied once for QUERY_BLOCK of its queries."""
        blocks = to.groupBy(*TREE).agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("blocks"))
        sent = join_small(to, blocks, TREE).withColumn("block", F.pmod(F.xxhash64("query_id", "q"), F.col("blocks"))).drop("blocks")
        copies = join_small(nodes, blocks, TREE, "inner").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")

        def both(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            return search_tree(left, right, m2, k)

        by = [*TREE, "block"]
        return copies.groupBy(*by).cogroup(sent.groupBy(*by)).applyInPandas(both, FOUND)

    nearest = asked.select("query_id", "q", "x", F.array_min("to").alias("t"))
    at = join_small(nearest, trees, F.col("t.region") == trees["region"], "inner").groupBy("query_id", "q").agg(F.first("x").alias("x"), F.min(F.struct(bound.alias("b"), *TREE)).alias("t"))
    first_to = table_cut(at.select("query_id", "q", "x", *[F.col("t")[c].alias(c) for c in TREE], F.lit(None).cast("long").alias("score")), "first-trees")
    first = table_cut(visit(first_to), "first-visits")
    kth = first.groupBy("query_id", "q").agg(F.when(F.count("*") >= k, F.min("score")).alias("score"))
    left = F.greatest(norm2 + F.lit(m2) - 2 * F.col("score").cast("double"), F.lit(0.0))
    reach = F.when(F.col("score").isNull(), F.lit(float("inf"))).otherwise(F.sqrt(left) * (1 + SLACK) + wide)
    rest = asked.join(kth, ["query_id", "q"], "left").withColumn("reach", reach).select("query_id", "q", "x", "score", "reach", F.explode("to").alias("t"))
    rest = join_small(rest, trees, F.col("t.region") == trees["region"], "inner").filter(bound <= F.col("reach") + wide).select("query_id", "q", "x", "score", *TREE)
    rest = table_cut(rest.join(first_to.select("query_id", "q", *TREE), ["query_id", "q", *TREE], "left_anti"), "other-trees")
    rank = F.row_number().over(Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id"))
    return first.unionByName(visit(rest)).withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
