"""Helpers that several operators of this package use: shared storage, small-side joins, row identity."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if it was counted and has at most this many (narrow) rows.
BROADCAST_ROWS = 200_000

_own_root: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where that is unset (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if "root" not in _own_root:
        _own_root["root"] = tempfile.mkdtemp(prefix="ledgerwell-")
        spark.sparkContext.setCheckpointDir(_own_root["root"])
    return _own_root["root"]


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is there when the driver ends is deleted."""
    path = f"{shared_root(spark)}/ledgerwell-{name}-{uuid.uuid4().hex}"
    atexit.register(drop_path, spark, path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path through Hadoop's file system; a stopped session has nothing left to do."""
    jvm = spark.sparkContext._jvm
    if jvm is None or spark.sparkContext._jsc is None:
        return
    try:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone already at exit
        return


def table_cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: later plans start here and survive lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_small(big: DataFrame, small: DataFrame, on, how: str = "left", rows: int | None = None) -> DataFrame:
    """Join with a side that is usually small: broadcast if it has at most BROADCAST_ROWS rows, else a plain shuffled join.

    `rows` is the row count of `small` where the caller knows it; otherwise it is counted.
    """
    rows = small.count() if rows is None else rows
    return big.join(F.broadcast(small) if rows <= BROADCAST_ROWS else small, on, how)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, base: str) -> str:
    """A column name like `base` that df doesn't have (names are compared without case, as Spark does)."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name += "_"
    return name


def words_in(text):
    """Number of runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
