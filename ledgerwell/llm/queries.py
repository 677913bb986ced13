"""The queries of this package: each applies one operator to its whole table; SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwell.llm import kd_shards as kd
from ledgerwell.llm import bpe, mixing, ordinal, token_files
from ledgerwell.llm.decontaminate import find_leaks
from ledgerwell.llm.divergence import source_divergence
from ledgerwell.llm.jaccard_join import near_duplicates
from ledgerwell.llm.metric_tree import quantise, top_k
from ledgerwell.llm.pseudonyms import pseudonymise
from ledgerwell.llm.runs import word_runs
from ledgerwell.llm.shared import free_name, join_small, words_in
from ledgerwell.llm.site_templates import main_text
from ledgerwell.llm.url_rules import RULE_SCHEMA, judge_urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, and batches for Python workers small enough for long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The rules of op1.
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]
SHARDS = 8
#: Where op7 takes its key from; the synthetic tables need no secret one.
KEY_SETTING = "spark.ledgerwell.pseudonyms.key"


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, RULE_SCHEMA)
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def metadata_dims(df: DataFrame, size: str) -> list:
    """Numeric metadata of a document for the k-d tree: log size, language and source as positions in [0, 1)."""
    spread = lambda c: F.pmod(F.xxhash64(F.coalesce(F.col(c), F.lit(""))), F.lit(1 << 20)) / float(1 << 20)
    return [F.log2(F.col(size) + 1.0) / 32, spread("lang"), spread("source")]


def op2_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "lang", "source", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32("text").alias("text_crc32"), F.xxhash64("text", F.col("text").isNull()).alias("text_hash"),
    )
    sharded = kd.kd_shards(docs, ["text_hash", "text_crc32", "size"], "size", metadata_dims(docs, "size"), shards=SHARDS)
    numbered = kd.number_rows(sharded, "shard", ["doc_id", "text_hash"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def label_weights(docs: DataFrame, labels: DataFrame, name: str) -> DataFrame:
    """docs with the weight of the fractional draw: 1 without a label, 0.5 to 1.5 by the mean of the quality labels."""
    uid, mark = free_name(docs, "label_id"), free_name(docs, "label_mark")
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias(uid)).agg(F.avg("quality").alias(mark))
    weight = F.coalesce(F.col(mark) + 0.5, F.lit(1.0))
    return join_small(docs, marks, F.col("doc_id") == F.col(uid)).withColumn(name, weight).drop(uid, mark)


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", words_in(F.col("text")).alias("words"), F.xxhash64("text").alias("text_hash"))
    docs = label_weights(docs, table(spark, sf_dir, "labels"), "mark")
    return mixing.mix_sources(docs, "source", F.col("words"), F.col("mark"), ["doc_id", "text_hash"]).select("doc_id", "size", "source_size", "target", "taken")


def op4_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_metric_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", quantise(F.col("embedding")).alias("x"))
    return top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0), 5)


def op7_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), spark.conf.get(KEY_SETTING, "for tables of invented documents"))
    return done.select("doc_id", "text", F.size("replaced").cast("long").alias("n_replaced"), "replaced")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    searched = find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return searched.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files.token_table(table(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path("word_bpe_49k.json"), 1)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = ordinal.select_good(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "expected_grade", "tail_probability", "kept")


def with_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text of docs; every tenth text, by the crc32 of its id, repeats a part of itself from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.expr(r"regexp_extract_all(coalesce(text, ''), r'[^\x20\x09-\x0D]+', 0)")
    numbered = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), (h % 10 == 0).alias("hit"), F.when(h % 10 == 0, words).alias("words")).withColumn("n", F.size("words"))
    a = numbered.withColumn("a", F.expr("if(hit and n > 0, g % n, null)")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    text = "array_join(slice(concat(slice(words, 1, cast(a as int)), flatten(array_repeat(slice(words, cast(a + 1 as int), cast(p as int)), cast((n - a) div p + 1 as int)))), 1, n), ' ')"
    return a.select("doc_id", F.expr(f"if(a is null, text, {text})").alias("text"))


def op11_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = word_runs(with_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))).select("doc_id", "periodic.*")
    better = "r.length * b.period > b.length * r.period or (r.length * b.period = b.length * r.period and (r.start < b.start or (r.start = b.start and r.period < b.period)))"
    best = runs.withColumn("best", F.expr(f"aggregate(slice(runs, 2, greatest(size(runs) - 1, 0)), get(runs, 0), (b, r) -> if({better}, r, b))"))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')"), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    done = bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "tokens.*")
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_kd_shards": op2_kd_shards,
    "op3_mix": op3_mix,
    "op4_site_templates": op4_site_templates,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_metric_tree": op6_metric_tree,
    "op7_pseudonyms": op7_pseudonyms,
    "op8_decontaminate": op8_decontaminate,
    "op9_token_files": op9_token_files,
    "op10_quality": op10_quality,
    "op11_word_runs": op11_word_runs,
    "op12_source_divergence": op12_source_divergence,
    "op13_bpe": op13_bpe,
}

OP1_SQL = r"""
WITH u AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), r(h, p, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block'))
SELECT page_id, host, path,
  (SELECT max_by(h || p, length(h || p)) FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS rule,
  coalesce((SELECT max_by(v, length(h || p)) FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)), 'allow') AS verdict
FROM u
"""

OP6_SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""

OP12_SQL = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS doc,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
o AS (SELECT lang, source, doc, term, count(*) AS n FROM (SELECT lang, source, doc, unnest(terms) AS term FROM d) GROUP BY ALL),
kept AS (SELECT lang, term, sum(n)::HUGEINT AS total FROM o GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, source, term, sum(n)::HUGEINT AS n FROM o JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT d.lang, d.source, coalesce(max(s.n), 0)::HUGEINT AS all_n, coalesce(max(k.v), 0)::HUGEINT AS v, max(k.n)::HUGEINT AS lang_n
  FROM (SELECT DISTINCT lang, source FROM d) d LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL) s ON s.lang = d.lang AND s.source = d.source
  LEFT JOIN (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang) k ON k.lang = d.lang GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (all_n + 5 * v) AS p, 1 + (1000000000::HUGEINT * (total + 5)) // (lang_n + 5 * v) AS q
  FROM g JOIN kept k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(max(value), 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart y ON y.lang = a.lang AND y.source = a.source AND y.item = b.source GROUP BY ALL
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM x QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= 50
"""

ORACLE_SQL: dict[str, str] = {"op1_url_filter": OP1_SQL, "op6_metric_tree": OP6_SQL, "op12_source_divergence": OP12_SQL}
