"""First and last row of a key.

Both are aggregates rather than ranked windows: each task keeps one row per
key before the shuffle, so a key that holds a third of the table stays small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    return _edge_row(df, keys, order_by, "min_by")


def last_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    return _edge_row(df, keys, order_by, "max_by")


def _edge_row(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], pick: str) -> DataFrame:
    rest = [F.col(f"`{name}`") for name in df.columns if name not in keys]
    row = (F.min_by if pick == "min_by" else F.max_by)(F.struct(*rest), F.struct(*[F.col(f"`{name}`") for name in order_by]))
    named = [F.col(f"`{name}`") for name in keys]
    kept = df.groupBy(*named).agg(row.alias("row")).select(*named, "row.*")
    return kept.select(*[F.col(f"`{name}`") for name in df.columns])


def dedupe_counts(df: DataFrame, key: str, order_by: Sequence[str]) -> DataFrame:
    """Non-null values per column once only the first row of each key is kept."""
    return first_per_key(df, [key], order_by).selectExpr(*[f"count(`{name}`) as `{name}`" for name in df.columns])
