"""Keyed tables whose upsert rewrites only the buckets that arriving keys fall into."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialised, released
from ..sources import versions
from .upsert import DEFAULT_KEYS


def bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(f"`{key}`") for key in keys]), F.lit(buckets))


def create(df: DataFrame, path: str, keys: Sequence[str] = DEFAULT_KEYS, buckets: int = 64) -> versions.Version:
    """Store a frame in buckets of its key; an upsert rewrites whole buckets, so a bucket should be a few files."""
    known = versions.version(df.sparkSession, path)
    if known.number:
        raise ValueError(f"there is a table in {path} already")
    pieces = versions.write_pieces(df, path, bucket(keys, buckets))
    return versions.commit(df.sparkSession, path, known, pieces, df.schema, {"keys": list(keys), "buckets": buckets})


def upsert(spark: SparkSession, path: str, incoming: DataFrame, notes: Mapping[str, object] | None = None) -> versions.Version:
    """Replace the stored rows whose key arrives by the arriving rows, in one step for readers.

    Buckets that no arriving key falls into are neither read nor written.  Rows
    with a null in their key are added and never replaced, as by ``upsert`` of frames.  A
    writer that another one was faster than gets a ``Conflict`` and may try again.

    ``notes`` are kept with the table and become valid in the same step as the rows.
    """
    known = versions.version(spark, path)
    if not known.number:
        raise ValueError(f"there is no table in {path}")
    keys, buckets = known.about["keys"], known.about["buckets"]
    with released():
        arriving = materialised(incoming.select(*[F.col(f"`{name}`") for name in known.schema.names]))
        touched = [str(r["b"]) for r in arriving.select(bucket(keys, buckets).alias("b")).distinct().collect()]  # at most all buckets
        if not touched and not notes:
            return known
        stored = versions.rows(spark, path, known, touched)
        kept = stored.join(arriving.select(*keys).distinct(), keys, "left_anti").select(*stored.columns)
        written = versions.write_pieces(kept.unionByName(arriving), path, bucket(keys, buckets))
    pieces = {name: folder for name, folder in known.pieces.items() if name not in touched} | written
    return versions.commit(spark, path, known, pieces, known.schema, {**known.about, **(notes or {})})


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the newest version; the frame stays with that version."""
    return versions.rows(spark, path)
