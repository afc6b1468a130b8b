"""Partial sums of stored facts, kept up to date month by month.

Partial sums by month, type, site and owner are far fewer rows than facts, and
all summary and trend reports can be answered from them.  A month is read again
only if its files have changed.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import partial_sums
from ..operators.totals import over
from ..schema import MEASURES
from . import versions
from .fact import read_fact

KEYS = ("perf_month", "ad_type", "account", "owner")
_NO_MONTH = "__HIVE_DEFAULT_PARTITION__"


def partials(facts: DataFrame) -> DataFrame:
    """Partial sums and the number of rows by month, type, site and owner."""
    keys = ", ".join(KEYS)
    return over(facts, f"select {keys}, count(*) as fact_rows, {', '.join(partial_sums(MEASURES))} from {{rows}} group by {keys}")


def file_marks(spark: SparkSession, facts_path: str) -> dict[str, str]:
    """Of each stored month: a text that changes with its files' names, sizes and times.  No file is opened."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(facts_path)
    month = F.coalesce(F.col("perf_month").cast("string"), F.lit(_NO_MONTH))
    digest = F.xxhash64("path", "modificationTime", "length").cast("decimal(20, 0)")
    marks = files.groupBy(month.alias("month")).agg(F.concat_ws(":", F.count(F.lit(1)), F.sum(digest)).alias("mark"))
    return {r["month"]: r["mark"] for r in marks.collect()}  # one row for each month


def refresh(
    spark: SparkSession, facts_path: str, path: str, build: Callable[[DataFrame], DataFrame] = partials
) -> versions.Version:
    """Bring a table of what ``build`` makes of each month's facts up to date with facts stored by month.

    Only months whose files have changed are read, and only their pieces are
    written; months that are gone leave the table.  ``build`` keeps
    ``perf_month``.  A refresh that fails leaves the table as it was.
    """
    known = versions.version(spark, path)
    marks, seen = file_marks(spark, facts_path), known.about.get("months", {})
    changed = [month for month, mark in marks.items() if seen.get(month) != mark]
    if known.number and not changed and len(seen) == len(marks):
        return known
    months = [date.fromisoformat(month) for month in changed if month != _NO_MONTH]
    asked = F.col("perf_month").isin(months)
    if _NO_MONTH in changed:
        asked = asked | F.col("perf_month").isNull()
    made = build(read_fact(spark, facts_path).where(asked))
    pieces = {month: folder for month, folder in known.pieces.items() if month in marks and month not in changed}
    if changed:
        pieces |= versions.write_pieces(made, path, F.col("perf_month").cast("string"))
    return versions.commit(spark, path, known, pieces, made.schema, {"months": marks})


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the table as last refreshed."""
    return versions.rows(spark, path)
