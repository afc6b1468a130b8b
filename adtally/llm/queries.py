"""One query per operator over the given tables, in the form its contract fixes."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adtally.llm import fill_middle, html_main, kdtree, language, licenses, minhash, mixing, packing, pair_maxscore, permutation_index, pii_crf, topk, url_trees
from adtally.llm.staging import staged

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

TOKENIZER = "word_bpe_49k.json"
#: Target weights of the mix; nodes that aren't listed weigh 1.
MIX_PATH = ["domain", "lang", "source"]
MIX_WEIGHTS = [
    ("domain", "domain0", 4),
    ("domain", "domain1", 3),
    ("domain", "domain2", 2),
    ("lang", "en", 5),
    ("lang", "de", 2),
    ("lang", "fr", 2),
]
MIX_EPOCHS = 4
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def mix_domain(source: Column) -> Column:
    """The tables have no domain; it is taken from the source's number."""
    return F.concat(F.lit("domain"), F.regexp_extract(source, r"(\d+)$", 1).try_cast("bigint") % 4)


def mix_rows(docs: DataFrame) -> DataFrame:
    return docs.select(mix_domain(F.col("source")).alias("domain"), "lang", "source", "doc_id", mixing.estimated_tokens(F.col("text")).alias("tokens"))


def mix_weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MIX_WEIGHTS, "level string, name string, weight long")


@query
def op1_best_fit_packing(spark, root):
    return packing.pack(table(spark, root, "documents"), public_tokenizers.path(TOKENIZER))


@query
def op2_permutation_search(spark, root):
    return permutation_index.nearest(table(spark, root, "embeddings"), "vec_id % 20 = 0", k=20)


@query
def op3_language_id(spark, root):
    docs = table(spark, root, "documents")
    profiles = language.learn(docs.where(~language.held_out()))
    judged = language.identify(docs.select("doc_id", "text"), profiles)
    return judged.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


@query
def op4_source_mixing(spark, root):
    rows = staged(mix_rows(table(spark, root, "documents")))
    return mixing.mixed(rows, MIX_PATH, mix_weights(spark), epochs=MIX_EPOCHS, id_column="doc_id")


@query
def op5_kd_shards(spark, root):
    placed = kdtree.shard(table(spark, root, "documents"), shards=40)
    return placed.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))


@query
def op6_norm_topk(spark, root):
    return topk.largest_products(table(spark, root, "embeddings"), "vec_id % 100 = 0", k=10)


@query
def op7_html_consensus(spark, root):
    return html_main.extract(table(spark, root, "pages").select("page_id", "url", "html")).drop("html")


@query
def op8_url_trees(spark, root):
    judged = url_trees.filtered(table(spark, root, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", F.col("blocked").alias("score"))


@query
def op9_minhash_dedup(spark, root):
    return minhash.components(table(spark, root, "documents"), shingle_words=4, percent=80)


@query
def op10_license_scan(spark, root):
    return licenses.digest(licenses.scan(table(spark, root, "documents")))


@query
def op11_fill_middle(spark, root):
    made = fill_middle.restored(fill_middle.transformed(table(spark, root, "documents").select("doc_id", "text")))
    digests = [F.sha2(F.col(c), 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


@query
def op12_pii_crf(spark, root):
    field = pii_crf.train(pii_crf.labelled_table(spark))
    found = pii_crf.found(table(spark, root, "documents").select("doc_id", "text"), field)
    base = F.filter("pii", lambda x: x["base"])
    kinds = F.transform(base, lambda x: x["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in pii_crf.KINDS]
    written = [F.sha2(pii_crf.written(base), 256).alias("base_sha256"), pii_crf.written(F.col("pii")).alias("spans")]
    return found.select("doc_id", *counts, *written)


@query
def op13_pair_maxscore(spark, root):
    return pair_maxscore.ranked(table(spark, root, "documents"), table(spark, root, "benchmark"), k=50)
