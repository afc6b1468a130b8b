"""Near duplicates: one-permutation hashing with optimal densification, banded buckets, star-shaped candidates.

1. Each text becomes the set of its distinct word shingles (64-bit hashes).
   Texts with equal sets are one node: copies never form pairs.
2. One hash per shingle fills the bins of a one-permutation sketch.  An empty
   bin takes the value of the first filled bin in an order of its own, fixed
   for all texts (optimal densification), so that bins agree with the
   probability of the sets' similarity.
3. Bands of bins are bucket keys.  The members of a bucket are compared with
   its smallest node only (a star): as many candidates as members.
4. Similarity is computed on the full shingle sets, and the links are closed
   to components by alternating large and small stars.
5. A star says nothing about two members that both differ from its centre.
   Where the members beside the centre still lie in several components, the
   bucket is compared in full, in blocks of bounded size: pairs of one
   component are passed over, the rest is tested and only true links leave
   the task.  So no bucket is capped and no link of a bucket is lost.

Two texts of similarity 0.8 share no bucket with a probability of 5e-7 at the
default 48 bands of 6 bins.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adtally.llm.staging import discard, free_names, release_unused, sent_if_small, ship, staged

BANDS, ROWS = 48, 6
#: Blocks of a bucket that is compared in full: so many nodes and shingles at most, one node at least.
BLOCK_NODES, BLOCK_SHINGLES = 256, 400_000
#: Sketches of at least threshold similarity agree in that share of bins less this margin, but for one pair in a million.
MARGIN = 0.14

_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: each output bit depends on all input bits."""
    x = (x ^ (x >> np.uint64(33))) * _MIX[0]
    x = (x ^ (x >> np.uint64(29))) * _MIX[1]
    return x ^ (x >> np.uint64(32))


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of the whole UTF-8 text.

    Words are runs without ASCII white space, A-Z lower-cased.  Fewer words
    than ``size`` make one shingle, no word makes none.
    """
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(size, len(words))
    rolled = mixed(hashes[: len(words) - size + 1] + np.uint64(size))
    for i in range(1, size):
        rolled = mixed(rolled * _STEP + hashes[i : len(words) - size + 1 + i])
    return np.unique(rolled)


@functools.lru_cache(maxsize=2)
def _orders(bins: int) -> np.ndarray:
    """Row j: the place of each bin in the order in which an empty bin j looks for a filled one."""
    draws = mixed(np.arange(bins * bins, dtype=np.uint64) * _STEP + np.uint64(1)).reshape(bins, bins)
    return draws.argsort(axis=1).argsort(axis=1).astype(np.int32)


def sketch(shingles: np.ndarray, bins: int) -> np.ndarray:
    """The least hash of each bin; empty bins take that of the first filled bin of their order."""
    draws = mixed(shingles + _STEP)
    at = (draws % np.uint64(bins)).astype(np.int64)
    order = np.lexsort((draws, at))
    filled, first = np.unique(at[order], return_index=True)
    out = np.zeros(bins, np.uint64)
    out[filled] = draws[order][first]
    if len(filled) < bins:
        empty = np.setdiff1d(np.arange(bins), filled, assume_unique=True)
        out[empty] = out[filled[_orders(bins)[empty][:, filled].argmin(axis=1)]]
    return out


def band_keys(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    grid = values.reshape(bands, rows)
    keys = mixed(np.arange(bands, dtype=np.uint64) + _STEP)
    for i in range(rows):
        keys = mixed(keys * _STEP + grid[:, i])
    return keys.view(np.int64)


def _sketched(batches: Iterator[pa.RecordBatch], size: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for batch in batches:
            counts, nodes, keys = [], [], []
            for text in batch.column(1).cast(pa.binary()):
                shingles = shingle_set(text.as_py(), size)
                counts.append(len(shingles))
                if len(shingles):
                    nodes.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                    keys.append(band_keys(sketch(shingles, bands * rows), bands, rows))
                else:
                    nodes.append(None)
                    keys.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(counts, pa.int64()), pa.array(nodes, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["id", "digest", "n_shingles", "node", "keys"],
            )
    release_unused()


def _full_sets(batches: Iterator[pa.RecordBatch], size: int, bins: int) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for batch in batches:
            sets = [shingle_set(text.as_py(), size) for text in batch.column(0).cast(pa.binary())]
            sets = [x for x in sets if len(x)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary()),
                    pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64())),
                    pa.array([sketch(x, bins).astype(np.uint16).tobytes() for x in sets], pa.binary()),
                ],
                ["node", "shingles", "sketch"],
            )
    release_unused()


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, for sorted distinct arrays."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _links_of_block(rows: pd.DataFrame, percent: int) -> list[tuple[int, int]]:
    """True links between components in one pair of blocks; ``side`` is 0 and 1, or 0 alone within one block."""
    sketches = np.stack([np.frombuffer(x, np.uint16) for x in rows["sketch"]])
    sets = [np.asarray(x) for x in rows["shingles"]]
    sets = [np.sort(x) for x in sets]
    sizes = np.array([len(x) for x in sets])
    side, comp, nid = rows["side"].to_numpy(), rows["comp"].to_numpy().copy(), rows["nid"].to_numpy()
    alone = not side.any()
    links = []
    for i in np.flatnonzero(side == 0):
        others = np.arange(i + 1, len(rows)) if alone else np.flatnonzero(side == 1)
        others = others[(comp[others] != comp[i]) & (100 * np.minimum(sizes[others], sizes[i]) >= percent * np.maximum(sizes[others], sizes[i]))]
        if len(others):
            agree = (sketches[others] == sketches[i]).mean(axis=1)
            for j in others[agree >= percent / 100 - MARGIN]:
                if comp[j] != comp[i] and similar(sets[i], sets[j], percent):
                    links.append((int(nid[i]), int(nid[j])))
                    comp[comp == comp[j]] = comp[i]
    return links


def _block_links(batches: Iterator[pd.DataFrame], percent: int) -> Iterator[pd.DataFrame]:
    """Rows come sorted by pair of blocks; a pair may go on in the next batch."""
    rest: pd.DataFrame | None = None
    keys = ["bucket", "low", "high"]

    def found(rows: pd.DataFrame) -> pd.DataFrame:
        links = [x for _, group in rows.groupby(keys, sort=False) for x in _links_of_block(group.reset_index(drop=True), percent)]
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    for batch in batches:
        rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        if len(rows):
            last = (rows[keys] == rows[keys].iloc[-1]).all(axis=1)
            rest = rows[last]
            yield found(rows[~last])
    if rest is not None and len(rest):
        yield found(rest)
    release_unused()


def connected(links: DataFrame) -> DataFrame:
    """``nid, comp`` for each node of the links ``(a, b)``: comp is the least node that can be reached.

    Alternating large and small stars: each round joins every node to the
    least node it knows, and the number of rounds grows with the logarithm of
    the longest chain.
    """
    edges = staged(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        before, edges = edges, staged(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct())
        discard(before)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == state or not now[0]:
            break
        state = now
    roots = edges.select(F.col("v").alias("nid")).distinct()
    return edges.select(F.col("u").alias("nid"), F.col("v").alias("comp")).unionByName(roots.withColumn("comp", F.col("nid")))


def components(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    shingle_words: int = 5,
    percent: int = 80,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """Per document: its id, ``n_shingles``, ``component_id`` and ``kept``.

    ``component_id`` is the smallest id that can be reached by links, its own
    included; ``kept`` marks the document of that id.  Texts that are null,
    empty or blank have no shingle and are linked with nothing.  Rows without
    an id are linked like others but never name a component; a component
    without any id has the component id null and its rows are kept.  Repeated
    rows give repeated results.  Other columns of ``docs`` aren't read.
    """
    read, grouped = _grouped(docs, id_column, text_column, shingle_words, percent, bands, rows)
    least = grouped.groupBy("comp").agg(F.min("first_id").alias("least_id"))
    named = grouped.join(least, "comp").select("node", "least_id", F.lit(True).alias("grouped"))
    out = read.select("id", "n_shingles", "node").join(named, "node", "left")
    component = F.when(F.col("grouped"), F.col("least_id")).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias(id_column),
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, component.isNull()).alias("kept"),
    )


def _grouped(docs: DataFrame, id_column: str, text_column: str, shingle_words: int, percent: int, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """Stored tables: each row's id, text digest, set size and node, and the nodes that share a component with another one or have copies."""
    ship(docs.sparkSession)
    texts = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    read = staged(
        texts.select("id", "text", F.xxhash64("text").alias("digest")).mapInArrow(
            lambda batches: _sketched(batches, shingle_words, bands, rows),
            "id long, digest long, n_shingles long, node binary, keys array<long>",
        )
    )
    nodes = staged(
        read.where("node is not null")
        .groupBy("node")
        .agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.any_value("keys").alias("keys"), F.max("n_shingles").alias("n"))
        .withColumn("nid", F.monotonically_increasing_id())
    )
    posted = nodes.select(F.explode("keys").alias("bucket"), "nid", "n")
    shared = posted.groupBy("bucket").agg(F.min(F.struct("nid", "n")).alias("c"), F.count(F.lit(1)).alias("members")).where("members > 1")
    shared = shared.select("bucket", F.col("c.nid").alias("centre"), F.col("c.n").alias("centre_n"))
    members = staged(posted.join(shared, "bucket"))

    wanted = members.select("nid").distinct().join(nodes.select("nid", "node", "first_id"), "nid")
    # Few documents share a bucket with another set; only their texts are read for it.
    ids = staged(wanted.select(F.col("first_id").alias("wanted")).distinct())
    again = texts.join(sent_if_small(ids), F.col("id").eqNullSafe(F.col("wanted")), "left_semi")
    sets = again.select("text").mapInArrow(
        lambda batches: _full_sets(batches, shingle_words, bands * rows), "node binary, shingles array<long>, sketch binary"
    )
    sets = sets.groupBy("node").agg(F.any_value("shingles").alias("shingles"), F.any_value("sketch").alias("sketch"))
    sets = staged(sets.join(wanted.select("nid", "node"), "node").select("nid", "shingles", "sketch"))

    close = f"nid <> centre and 100 * least(n, centre_n) >= {percent} * greatest(n, centre_n)"
    stars = members.where(close).select(F.col("nid").alias("a"), F.col("centre").alias("b"), "n", F.col("centre_n").alias("m")).distinct()
    stars = stars.join(sets.select(F.col("nid").alias("a"), F.col("shingles").alias("x")), "a")
    stars = stars.join(sets.select(F.col("nid").alias("b"), F.col("shingles").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    true = 100 * both >= percent * (F.col("n") + F.col("m") - both)
    links = staged(stars.where(true).select("a", "b"))

    comps = connected(links)
    placed = members.join(comps, "nid", "left").withColumn("comp", F.coalesce("comp", "nid"))
    open_ = (
        placed.where("nid <> centre")
        .groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("size"), F.sum(F.xxhash64("nid").cast("decimal(20,0)")).alias("who"), F.min("comp").alias("c0"), F.max("comp").alias("c1"))
        .where("c0 <> c1")
        .groupBy("size", "who")
        .agg(F.min("bucket").alias("bucket"))  # buckets of the same members are compared once
    )
    rest = staged(placed.where("nid <> centre").join(open_.select("bucket"), "bucket").select("bucket", "nid", "n", "comp"))
    blocks = rest.groupBy("bucket").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_NODES), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    )
    split = rest.join(blocks, "bucket").withColumn("block", F.pmod(F.xxhash64("nid"), F.col("blocks")).cast("int"))
    pairs = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        F.when(F.col("block") > F.col("other"), 1).otherwise(0).alias("side"), "nid", "comp",
    )
    filled = pairs.join(sets.select("nid", "shingles", "sketch"), "nid")
    dealt = filled.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")
    more = dealt.mapInPandas(lambda batches: _block_links(batches, percent), "a long, b long")
    more = staged(more.distinct())
    comps = connected(links.unionByName(more))

    grouped = nodes.select("nid", "node", "first_id", "copies").join(comps, "nid", "left")
    grouped = staged(grouped.where("comp is not null or copies > 1").withColumn("comp", F.coalesce("comp", "nid")))
    return read, grouped


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle_words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``docs`` without near copies: one row of each component, the one of the smallest id (null is last) and then text digest.

    An id says nothing about a text: rows of one id with texts that aren't near
    copies all stay.  Rows without a shingle (null, empty or blank texts) stay.
    """
    read, grouped = _grouped(docs, id_column, text_column, shingle_words, percent, bands, rows)
    keys = read.select("node", "id", "digest").join(grouped.select("node", "comp"), "node")
    keys = staged(keys.groupBy("comp", "id", "digest").agg(F.count(F.lit(1)).alias("copies")))
    key = F.struct(F.col("id").isNull().alias("no_id"), "id", "digest")
    best = keys.groupBy("comp").agg(F.min(key).alias("best"))
    of_id, of_text, stays = free_names(docs, "id", "digest", "stays")
    judged = keys.join(best, "comp").select(F.col("id").alias(of_id), F.col("digest").alias(of_text), "copies", (key == F.col("best")).alias(stays))
    # Only rows that go or repeat are looked up: few beside all documents, so that texts mostly stay where they are.
    touched = staged(judged.where(~F.col(stays) | (F.col("copies") > 1)).drop("copies"))
    own_id, own_text = F.col(f"`{id_column}`").cast("long"), F.col(f"`{text_column}`").cast("string")
    found = docs.join(sent_if_small(touched), own_id.eqNullSafe(F.col(of_id)) & (F.xxhash64(own_text) == F.col(of_text)), "left")
    own = [F.col(f"`{c}`") for c in docs.columns]
    once = found.where(F.col(stays).isNull()).select(*own)
    repeated = found.where(stays).dropDuplicates([of_id, of_text]).select(*own)
    return once.unionByName(repeated)
