"""Extract of a month's fact rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import in_month, month_text
from ..schema import SOURCE_COLUMNS
from ..sources.fact import in_currency

# Fixed value: file name stem of an extract.
FILE_STEM = "base_data"
LONG_NAMES = {name: short for name, short in SOURCE_COLUMNS.items() if short == "gross_margin_delta"}


def month_extract(df: DataFrame, ym: str) -> DataFrame:
    """All columns of a month's rows; the month as text, money in currency, the long name shortened."""
    rows = in_currency(df.where(in_month("perf_month", ym)).withColumnsRenamed(LONG_NAMES))
    return rows.withColumn("perf_month", F.expr(month_text("perf_month")))


def write_extract(df: DataFrame, ym: str, folder: str, fmt: str = "csv") -> str:
    """Write a month's extract into a folder named by the month and return its path."""
    path = f"{folder}/{FILE_STEM}_{ym}"
    writer = month_extract(df, ym).write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.save(path)
    return path
