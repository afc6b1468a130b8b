"""Shards by a k-d tree over metadata, split at distributed weighted medians.

Equal texts are one unit, unless they fill half a shard: then they are cut
into units of an eighth of a shard.  A unit has a size in bytes and a point of
metadata.  A node of the tree that stands for several shards is split along
its widest dimension, at the weighted quantile that gives both sides the bytes
of their shards, until each node is one shard.

A quantile is found by counting bytes in buckets of the dimension, then in
buckets of the bucket that holds it, until what is left in one is a sliver of
a shard.  Only those few numbers of each node reach the driver.  Where a cut falls inside a large unit, one
unit of the heavier side whose size fits best changes sides.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adtally.llm.ranks import ranked
from adtally.llm.staging import staged

#: Bits of a key that come from the dimension and from the hash behind it, and of a bucket's number.
VALUE_BITS, HASH_BITS, BUCKET_BITS = 31, 31, 10
#: A quantile is near enough if it is off by no more than this share of a shard.
SLIVER = 0.002


@dataclass
class Node:
    """A part of the tree: its shards, and while it is being split the span of keys that holds the cut."""

    first: int
    shards: int
    dimension: str = ""
    low: float = 0.0
    high: float = 0.0
    wanted: float = 0.0
    start: int = 0
    shift: int = 0
    cut: int | None = None
    over: float = 0.0


def _key(node: Node) -> Column:
    """Order along the node's dimension; units of like value are ordered by a hash."""
    spread = node.high - node.low
    value = F.floor((F.col(node.dimension) - F.lit(node.low)) / F.lit(spread) * F.lit(float((1 << VALUE_BITS) - 1))) if spread else F.lit(0)
    return value.cast("long") * F.lit(1 << HASH_BITS) + F.col("hash")


def _by_node(nodes: dict[int, Node], value) -> Column:
    out = F.lit(None).cast("long")
    for number, node in nodes.items():
        out = F.when(F.col("node") == number, value(node)).otherwise(out)
    return out


def _split(units: DataFrame, nodes: dict[int, Node], dimensions: list[str], spans: dict[str, float], sliver: float) -> DataFrame:
    """Units with their ``node`` one level further down; ``nodes`` is changed accordingly."""
    ends = [f(d).alias(f"{name}_{d}") for d in dimensions for name, f in (("low", F.min), ("high", F.max))]
    facts = units.where(F.col("node").isin(list(nodes))).groupBy("node").agg(F.sum("bytes").alias("bytes"), *ends).collect()  # a row for each node
    busy: dict[int, Node] = {}
    for row in facts:
        node = nodes[row["node"]]
        wide = {d: (row[f"high_{d}"] - row[f"low_{d}"]) / spans[d] if spans[d] else 0.0 for d in dimensions}
        node.dimension = max(dimensions, key=lambda d: wide[d])
        node.low, node.high = row[f"low_{node.dimension}"], row[f"high_{node.dimension}"]
        node.wanted = row["bytes"] * (node.shards // 2) / node.shards
        node.start, node.shift, node.cut = 0, VALUE_BITS + HASH_BITS - BUCKET_BITS, None
        busy[row["node"]] = node
    keyed = staged(units.withColumn("key", F.coalesce(_by_node(busy, _key), F.lit(0))))
    while open_ := {n: x for n, x in busy.items() if x.cut is None}:
        inside = _of_nodes(keyed, {n: (x.start, x.shift, float(x.wanted)) for n, x in open_.items()}, "start long, shift int, wanted double")
        bucket = F.call_function("shiftright", F.col("key") - F.col("start"), F.col("shift"))
        # What lies before the span counts as bucket -1, what lies behind it as one bucket more.
        sums = inside.withColumn("bucket", F.least(F.greatest(bucket, F.lit(-1)), F.lit(1 << BUCKET_BITS)))
        sums = sums.groupBy("node", "wanted", "bucket").agg(F.sum("bytes").alias("bytes"))
        upto = Window.partitionBy("node").orderBy("bucket")
        sums = sums.withColumn("upto", F.sum("bytes").over(upto))
        hold = sums.where("upto >= wanted").groupBy("node").agg(F.min_by(F.struct("bucket", "bytes", "upto"), "bucket").alias("x"))
        for row in hold.select("node", "x.*").collect():  # a row for each node
            node = open_[row["node"]]
            node.start += row["bucket"] << node.shift
            before = row["upto"] - row["bytes"]
            if row["bytes"] <= sliver or not node.shift:
                nearer = node.wanted - before <= row["upto"] - node.wanted
                node.cut = node.start + (0 if nearer else 1 << node.shift)
                node.over = (before if nearer else row["upto"]) - node.wanted
            else:
                node.shift = max(0, node.shift - BUCKET_BITS)
    empty = set(nodes) - set(busy)
    sides = {}
    for number, node in busy.items():
        left = node.shards // 2
        # A node keeps its number on the left; the right side has that of its first shard.
        right = Node(node.first + left, node.shards - left)
        sides[number] = (node.cut, right.first)
        nodes[right.first] = right
        node.shards = left
    for number in empty:  # nothing lies there
        nodes[number].shards = 1
    sided = _of_nodes(keyed, sides, "cut long, other int", "left").withColumn("right", F.coalesce(F.col("key") >= F.col("cut"), F.lit(False)))
    uneven = {n: (float(busy[n].over),) for n in busy if abs(busy[n].over) > sliver}
    if uneven:
        sided = _evened(sided, _of_nodes(sided, uneven, "over double"))
    return sided.withColumn("node", F.when(F.col("right"), F.col("other")).otherwise(F.col("node"))).select(*units.columns)


def _of_nodes(units: DataFrame, values: dict[int, tuple], kind: str, how: str = "inner") -> DataFrame:
    """``units`` with columns that hold a few values for each node; there are no more nodes than shards."""
    table = units.sparkSession.createDataFrame([(n, *x) for n, x in values.items()], f"__node int, {kind}")
    return units.join(F.broadcast(table), F.col("node") == F.col("__node"), how).drop("__node")


def _evened(sided: DataFrame, uneven: DataFrame) -> DataFrame:
    """Where a cut fell inside a large unit, the unit of the heavier side whose size evens it out best changes sides."""
    heavier = (F.col("over") > 0) != F.col("right")
    rows = uneven.where(heavier & (F.col("bytes") < 2 * F.abs("over")))
    gap = F.abs(F.col("bytes") - F.abs("over"))
    best = rows.groupBy("node").agg(F.min_by(F.struct("same", "part"), F.struct(gap, "hash", "same", "part")).alias("x"))
    chosen = best.select(F.col("node").alias("__node"), F.col("x.same").alias("__same"), F.col("x.part").alias("__part"), F.lit(True).alias("__turns"))
    this = (F.col("node") == F.col("__node")) & (F.col("same") == F.col("__same")) & (F.col("part") == F.col("__part"))
    # One row for each node at most.
    turned = sided.join(F.broadcast(chosen), this, "left")
    return turned.withColumn("right", F.col("right") != F.coalesce("__turns", F.lit(False))).drop("__node", "__same", "__part", "__turns")


def shard(
    docs: DataFrame,
    shards: int = 40,
    id_column: str = "doc_id",
    text_column: str = "text",
    categories: tuple[str, ...] = ("lang", "source"),
    overhead: int = 16,
) -> DataFrame:
    """Per document: id, ``size``, ``text_crc32``, ``shard`` and ``slot`` (0, 1, 2 ... within the shard).

    Size is the text's UTF-8 bytes plus ``overhead``.  The dimensions are the
    id, the size and a number for each category.  Null texts count as empty,
    null ids and categories as 0.  Rows that repeat an id, also whole rows,
    are placed each.  Shards may stay empty if there are fewer units.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_column).cast("long").alias("id"),
        (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.md5(text.cast("binary"))).alias("same"),
        *[F.coalesce(F.crc32(F.col(c).cast("string").cast("binary")), F.lit(0)).cast("double").alias(f"at_{c}") for c in categories],
    )
    rows = staged(rows)
    total = rows.agg(F.sum("size")).first()[0] or 0
    share = total / shards
    # Texts that fill half a shard: no more than twice as many as shards.
    large = rows.groupBy("same").agg(F.sum("size").alias("all")).where(F.col("all") > share / 2)
    large = large.select(F.col("same").alias("__same"), F.ceil(F.col("all") / (share / 8)).alias("parts")) if total else large.select(F.col("same").alias("__same"), F.lit(1).alias("parts"))
    cut = rows.join(F.broadcast(large), F.col("same") == F.col("__same"), "left")
    part = F.coalesce(F.pmod(F.xxhash64("id", "size"), F.col("parts")), F.lit(0)).cast("int")
    cut = cut.select("id", "size", "text_crc32", "same", part.alias("part"), *[f"at_{c}" for c in categories])
    dimensions = ["at_id", "at_size", *[f"at_{c}" for c in categories]]
    units = cut.groupBy("same", "part").agg(
        F.sum("size").alias("bytes"),
        F.coalesce(F.min("id"), F.lit(0)).cast("double").alias("at_id"),
        F.log2(F.max("size").cast("double")).alias("at_size"),
        *[F.min(f"at_{c}").alias(f"at_{c}") for c in categories],
    )
    units = units.withColumn("hash", F.pmod(F.xxhash64("same", "part"), F.lit(1 << HASH_BITS))).withColumn("node", F.lit(0))
    units = staged(units)
    spans = units.agg(*[(F.max(d) - F.min(d)).alias(d) for d in dimensions]).first().asDict()
    spans = {d: spans[d] or 0.0 for d in dimensions}
    nodes = {0: Node(0, shards)}
    while total and any(x.shards > 1 for x in nodes.values()):
        level = {n: x for n, x in nodes.items() if x.shards > 1}
        units = _split(units, level, dimensions, spans, share * SLIVER)
        nodes |= level
    placed = units.select(F.col("same").alias("__same"), F.col("part").alias("__part"), F.col("node").cast("int").alias("shard"))
    here = (F.col("same") == F.col("__same")) & (F.col("part") == F.col("__part"))
    out = staged(cut.join(placed, here).select("id", "size", "text_crc32", "shard"))
    return ranked(out, "shard", "slot").withColumnRenamed("id", id_column)
