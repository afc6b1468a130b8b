"""Gapless ranks within keys, also where one key holds most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: About so many rows of a key are numbered by one task.
ROWS_PER_SLICE = 20_000


def ranked(df: DataFrame, key: str, name: str, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """``df`` with a long column ``name``: 0, 1, 2 ... within each value of ``key``, in no particular order.

    Each key is cut into slices by a hash of the whole row, as many as its row
    count asks for.  Rows are numbered inside their slice and slices get
    offsets from their counts, so no task holds a whole key.  Rows alike in
    all columns share a slice, and it doesn't matter which gets which number.
    ``df`` must be a stored table, as it is read twice.
    """
    columns = [F.col(c) for c in df.columns]
    slices: Column = F.ceil(F.col("__n") / F.lit(rows_per_slice))
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).withColumn("__cuts", slices).drop("__n")
    cut = F.pmod(F.xxhash64(*columns), F.col("__cuts")).alias("__cut")
    sliced = df.join(sizes.withColumnRenamed(key, "__key"), F.col(key).eqNullSafe(F.col("__key"))).select(*columns, cut)
    counts = sliced.groupBy(key, "__cut").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(key).orderBy("__cut").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col(key).alias("__key"), F.col("__cut").alias("__slice"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")
    )
    within = Window.partitionBy(key, "__cut").orderBy(*columns)
    numbered = sliced.withColumn("__row", F.row_number().over(within))
    same = F.col(key).eqNullSafe(F.col("__key")) & (F.col("__cut") == F.col("__slice"))
    place = (F.col("__before") + F.col("__row") - 1).cast("long").alias(name)
    return numbered.join(offsets, same).select(*columns, place)
