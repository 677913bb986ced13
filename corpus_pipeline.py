"""The corpus pipeline: documents are filtered, deduplicated, decontaminated, mixed and sharded, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns that they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwell.llm import kd_shards, mixing, ordinal
from ledgerwell.llm.decontaminate import find_leaks
from ledgerwell.llm.jaccard_join import keep_one
from ledgerwell.llm.queries import SHARDS, label_weights, metadata_dims, table
from ledgerwell.llm.shared import free_name, table_cut, words_in


def _columns(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in names])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier, fitted on the labelled ones among them, keeps."""
    return _columns(ordinal.select_good(docs, table(spark, sf_dir, "labels")).filter("kept"), docs.columns)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    return _columns(keep_one(docs), docs.columns)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return _columns(find_leaks(docs, table(spark, sf_dir, "benchmark")).filter(F.size("leaks") == 0), docs.columns)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: complete epochs, and once more if the fractional draw takes it."""
    weight, hashed = free_name(docs, "mark"), free_name(docs, "text_hash")
    weighed = label_weights(docs.withColumn(hashed, F.xxhash64("text")), table(spark, sf_dir, "labels"), weight)
    mixed = mixing.mix_sources(weighed, "source", words_in(F.col("text")), F.col(weight), ["doc_id", hashed])
    repeated = mixed.filter("copies > 0").select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias(free_name(docs, "copy")))
    return _columns(repeated, docs.columns)


def shard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard, of nearly equal bytes."""
    size, hashed = free_name(docs, "bytes"), free_name(docs, "text_hash")
    sized = docs.withColumn(size, (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")).withColumn(hashed, F.xxhash64("text", F.col("text").isNull()))
    sharded = kd_shards.kd_shards(sized, [hashed, size], size, metadata_dims(sized, size), shards=SHARDS)
    return _columns(sharded, [*[c for c in docs.columns if c.lower() != "shard"], "shard"])


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram jaccard join", dedup_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("mixing sources", mix_stage),
    ("sharding", shard_stage),
]

#: SQL can express neither the classifier nor the draws; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = table_cut(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
