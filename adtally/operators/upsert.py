"""Replace rows by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..session import materialised, released

DEFAULT_KEYS = ("account",)


def upsert(current: DataFrame, incoming: DataFrame, keys: Sequence[str] = DEFAULT_KEYS) -> DataFrame:
    """Current rows whose key does not arrive again, and all incoming rows.

    Incoming rows are written once to the shared folder, since both their keys
    and they themselves are read.
    """
    incoming = materialised(incoming)
    arrived = incoming.select(*keys).distinct()
    return current.join(arrived, list(keys), "left_anti").select(*current.columns).unionByName(incoming)


def save_upsert(
    spark: SparkSession, current_path: str, incoming: DataFrame, new_path: str, keys: Sequence[str] = DEFAULT_KEYS
) -> None:
    """Write the upserted table to a new folder; the current one stays readable throughout."""
    if current_path.rstrip("/") == new_path.rstrip("/"):
        raise ValueError("write the new table beside the current one")
    with released():
        upsert(spark.read.parquet(current_path), incoming, keys).write.mode("errorifexists").parquet(new_path)


def replace_partitions(incoming: DataFrame, path: str, by: str) -> None:
    """Overwrite the partitions present in the frame and leave the others alone."""
    (
        incoming.hint("rebalance", by)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(by)
        .parquet(path)
    )
