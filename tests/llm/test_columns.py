"""Extra columns with the names that operators use inside, in every operator."""

from pyspark.sql import functions as F

from ledgerwell.llm import kd_shards as kd
from ledgerwell.llm import mixing, ordinal
from ledgerwell.llm.decontaminate import find_leaks
from ledgerwell.llm.jaccard_join import keep_one, near_duplicates
from ledgerwell.llm.metric_tree import top_k
from ledgerwell.llm.pseudonyms import pseudonymise
from ledgerwell.llm.queries import label_weights
from ledgerwell.llm.site_templates import main_text
from ledgerwell.llm.token_files import token_table
from ledgerwell.llm.url_rules import RULE_SCHEMA, judge_urls

NAMES = [
    "row", "g", "sub", "piece", "h", "s_g", "p_g", "base", "bucket", "local", "size", "source_size", "target", "left", "uid", "key", "src", "t_source", "d_uid", "d_source", "epochs", "copies", "taken",
    "host", "path", "rule", "verdict", "pos", "labels", "salt", "page", "gone", "subtree", "html_", "n_chars", "found", "replaced", "kind", "leaks", "l", "item_id", "cls", "n", "bits", "row_key", "w_id",
    "component_id", "expected_grade", "tail_probability", "kept", "scored", "grade", "f", "start", "n_tokens", "ids_crc32", "label_id", "label_mark", "r", "q", "rank", "score", "region", "x1", "index", "none",
]


def _clashing(spark, rows, schema):
    df = spark.createDataFrame(rows, schema)
    return df.select("*", *[F.lit(f"mine {n}").alias(n) for n in NAMES if n.lower() not in {c.lower() for c in df.columns}])


def _kept(df, made=()):
    """Rows that keep the values of all columns that the operator doesn't make."""
    rows = df.collect()
    assert all(r[n] == f"mine {n}" for r in rows for n in NAMES if n in df.columns and n not in made)
    assert set(NAMES) - set(made) <= set(df.columns)
    return rows


def test_clashing_columns_of_documents(spark):
    docs = _clashing(spark, [(1, "a b c d e f", "s", "en"), (1, "a b c d e f", "s", "en"), (2, None, None, None), (3, "", "t", "de"), (4, "x " * 5000, "t", "de")], "doc_id long, text string, source string, lang string")
    labels = _clashing(spark, [(1, 1, 0), (4, 0, 1)], "doc_id long, quality int, toxic int")
    sized = docs.withColumn("w", F.lit(3).cast("long"))
    sharded = kd.kd_shards(sized, ["text"], "w", [F.col("w")], shards=2)
    assert len(_kept(sharded)) == 5 and len(_kept(kd.number_rows(sharded, "shard", ["doc_id"]))) == 5
    weighed = label_weights(docs, labels, "mark")
    mixed = mixing.mix_sources(weighed, "source", F.length("text"), F.col("mark"), ["doc_id", "text"])
    assert len(_kept(mixed, ("size", "source_size", "target", "copies", "taken"))) == 5
    assert len(_kept(pseudonymise(docs, "k"), ("replaced",))) == 5
    assert len(_kept(find_leaks(docs, _clashing(spark, [(1, "a b c d e f")], "item_id long, text string")), ("leaks",))) == 5
    assert len(_kept(ordinal.select_good(docs, labels), ("expected_grade", "tail_probability", "kept"))) == 5
    assert len(_kept(keep_one(docs))) == 4 and near_duplicates(docs).count() == 5
    import public_tokenizers

    assert token_table(docs, "doc_id", "text", public_tokenizers.path("word_bpe_49k.json"), 1).count() == 5


def test_clashing_columns_of_pages_and_vectors(spark):
    pages = _clashing(spark, [(1, "http://a.com/en/", "<p>x</p>"), (2, None, None), (2, None, None)], "page_id int, url string, html string")
    assert len(_kept(main_text(pages), ("text", "n_chars"))) == 3
    assert len(_kept(judge_urls(pages, _clashing(spark, [("com", "/en/", "block")], RULE_SCHEMA)), ("host", "path", "rule", "verdict"))) == 3
    vectors = _clashing(spark, [(1, [1, 2]), (2, [3, 4]), (2, [3, 4]), (None, [1, 1]), (3, None)], "vec_id long, x array<long>")
    assert sorted(map(tuple, top_k(vectors, vectors, 2).collect())) == [(1, 1, 2, 11), (1, 2, 2, 11), (2, 1, 1, 11)]
