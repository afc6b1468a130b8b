"""Shards: sizes near equal, slots gapless, equal texts together, splits along the widest dimension."""

import zlib

from pyspark.sql import functions as F

from adtally.llm import kdtree
from adtally.llm.queries import QUERIES


def check(rows, shards):
    slots, sizes = {}, dict.fromkeys(range(shards), 0)
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
        sizes[r.shard] += r["size"]
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    return sizes


def test_small_table(spark, root, texts):
    rows = QUERIES["op5_kd_shards"](spark, root).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        own = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(own) + 16, zlib.crc32(own), "bytes", None)
    sizes = check(rows, 40)
    assert sum(sizes.values()) == sum(r["size"] for r in rows)


def test_sizes_near_equal_and_copies_together(spark):
    docs = spark.range(20_000).select(
        F.col("id").alias("doc_id"),
        F.concat(F.lit("text "), F.expr("repeat('ab ', cast(10 + id % 97 as int))"), F.expr("cast(id div 3 as string)")).alias("text"),
        F.expr("case when id % 3 = 0 then 'en' when id % 100 = 1 then null else 'de' end").alias("lang"),
        F.expr("case when id % 2 = 0 then 'hot' else concat('s', id % 50) end").alias("source"),
    )
    rows = kdtree.shard(docs, 7).collect()
    sizes = check(rows, 7)
    assert max(sizes.values()) <= 1.02 * min(sizes.values())
    together = {}
    for r in rows:
        together.setdefault(r.text_crc32, set()).add(r.shard)
    assert all(len(x) == 1 for x in together.values())


def test_hot_text_is_cut(spark):
    """A third of all rows is one text; shards still are near equal."""
    docs = spark.range(9000).selectExpr("id doc_id", "case when id % 3 = 0 then 'the same text again' else concat('text of ', id) end text", "'en' lang", "'s' source")
    sizes = check(kdtree.shard(docs, 10).collect(), 10)
    assert max(sizes.values()) <= 1.15 * min(sizes.values())


def test_splits_follow_the_widest_dimension(spark):
    """Two languages far apart in one dimension only: the first split parts them."""
    docs = spark.range(400).selectExpr("7L doc_id", "concat('t', 1000 + id) text", "if(id < 200, 'aa', 'bb') lang", "'s' source")
    rows = kdtree.shard(docs.withColumn("id_", F.col("doc_id")), 2)
    parts = {r.shard: r.langs for r in rows.join(docs.select(F.crc32(F.col("text").cast("binary")).alias("text_crc32"), "lang"), "text_crc32").groupBy("shard").agg(F.collect_set("lang").alias("langs")).collect()}
    assert sorted(map(tuple, parts.values())) == [("aa",), ("bb",)]


def test_odd_rows(odd_docs, no_docs):
    rows = kdtree.shard(odd_docs, 3).collect()
    check(rows, 3)
    assert len(rows) == odd_docs.count()
    assert {(r["size"], r.text_crc32) for r in rows if r.doc_id in (3, 4)} == {(16, 0)}
    assert kdtree.shard(no_docs, 3).count() == 0
