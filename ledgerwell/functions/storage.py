"""Tables kept in the shared folder: written once, read by every later plan, there for executors that start anew."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_root: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all machines of a cluster share; a temporary folder where it is unset (one machine)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if "root" not in _own_root:
        _own_root["root"] = tempfile.mkdtemp(prefix="ledgerwell-tables-")
    return _own_root["root"]


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, deleted when the driver ends."""
    path = f"{shared_root(spark)}/ledgerwell-{name}-{uuid.uuid4().hex}"
    atexit.register(drop_path, spark, path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to a new table and read back."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def application_and_files(spark: SparkSession, sf_dir: str, *tables: str) -> tuple:
    """What a table made of these ones is kept under: another application or an input file that is another one needs a new table."""
    return (spark.sparkContext.applicationId, sf_dir, *(state for t in tables for state in file_states(spark, f"{sf_dir}/{t}.parquet")))


def file_states(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(name, size, time of change) of the files at a path, in order: another table there has other ones."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target)
    fs, out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), []
    for top in found or []:
        for s in fs.listStatus(top.getPath()) if top.isDirectory() else [top]:
            out.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
    return sorted(out)


def files_of(spark: SparkSession, path: str) -> list[str]:
    """The files in the folders that a pattern names; none if it names none."""
    return [name for name, _, _ in file_states(spark, path)]


def drop_path(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jvm is None or spark.sparkContext._jsc is None:
        return
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone already at exit
        return
