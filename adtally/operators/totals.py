"""Grouped totals of the fact table.

Every total is one aggregation straight from the fact rows, so Spark combines
partial sums before it shuffles and a hot month, type or owner costs no more
than any other.  Stored partial sums (``sources.partials``) may stand in for
the fact rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import MONTH_TEXT, month_key
from ..functions.money import merged_sums, settled, settled_as, sums_over
from ..functions.scope import CHANNEL
from ..schema import MEASURES


# Logarithm of a sketch's registers.
SKETCH_BITS = 12


def over(df: DataFrame, text: str) -> DataFrame:
    """A SQL statement over a frame, which it names ``{rows}``."""
    return df.sparkSession.sql(text, rows=df)


def aggregated(
    df: DataFrame, by: Sequence[str], aggregates: Sequence[str], results: Sequence[str] = ("*",)
) -> DataFrame:
    """Grouped aggregates, and result expressions over them, written as SQL text."""
    by = [f"`{name}`" for name in by]
    keys = ", ".join(by)
    return over(
        df,
        f"""select {", ".join(results)}
            from (select {", ".join([*by, *aggregates])} from {{rows}} group by {keys})""",
    )


def group_totals(df: DataFrame, by: Sequence[str], measures: Sequence[str] = MEASURES) -> DataFrame:
    """Sums of the measures per group; money comes out as double currency."""
    return aggregated(df, by, sums_over(df.columns, measures), [*[f"`{name}`" for name in by], *settled_as(measures)])


def month_totals(df: DataFrame, by: Sequence[str], measures: Sequence[str] = MEASURES) -> DataFrame:
    """Sums of the measures per month and further columns, the month as text."""
    results = [MONTH_TEXT, *[f"`{name}`" for name in by], *settled_as(measures)]
    return aggregated(df, ["perf_month", *by], sums_over(df.columns, measures), results)


def channel_month_totals(df: DataFrame) -> DataFrame:
    """Spend and ad revenue per month and channel, in that order."""
    rows = df.withColumn("channel", F.expr(CHANNEL))
    return month_totals(rows, ["channel"], ("spend", "ad_revenue")).orderBy("perf_month", "channel")


def type_month_totals(df: DataFrame) -> DataFrame:
    """Spend and ad revenue per month and raw ad type, in that order."""
    return month_totals(df, ["ad_type"], ("spend", "ad_revenue")).orderBy("perf_month", "ad_type")


def scope_total(df: DataFrame) -> DataFrame:
    """One line of measure sums per month; no line for a month without rows."""
    return month_totals(df, [])


def owner_breakdown(df: DataFrame) -> DataFrame:
    """One line of measure sums per month and owner."""
    return month_totals(df, ["owner"])


def lines_with_totals(df: DataFrame) -> DataFrame:
    """Owner lines and their month's total line in one scan of the facts.

    Owners are summed first and the grouping sets run over those few sums, so
    the facts are not doubled by the second grouping.
    """
    return over(
        df,
        f"""select perf_month, owner, is_total, {", ".join(settled_as(MEASURES))}
            from (
                select perf_month, owner, cast(grouping(owner) as int) as is_total, {", ".join(merged_sums(MEASURES))}
                from (
                    select perf_month, owner, {", ".join(sums_over(df.columns, MEASURES))}
                    from {{rows}} group by perf_month, owner
                )
                group by grouping sets ((perf_month), (perf_month, owner))
            )""",
    )


def latest_month(df: DataFrame) -> DataFrame:
    """Newest month as ``YYYYMM``."""
    return df.selectExpr("max(perf_month) as perf_month").selectExpr(f"{month_key('perf_month')} as latest_month")


def newest_month_rows(df: DataFrame) -> DataFrame:
    """Rows of the newest month; the month is a scalar subquery, found when the frame runs."""
    return df.where(F.col("perf_month") == df.agg(F.max("perf_month")).scalar())


def month_list(df: DataFrame, newest_first: bool = True) -> DataFrame:
    """Months that have rows."""
    months = df.select("perf_month").distinct().selectExpr(MONTH_TEXT)
    return months.orderBy("perf_month", ascending=not newest_first)


def distinct_accounts(df: DataFrame, column: str = "account") -> DataFrame:
    """Exact number of different values, NULL not counted."""
    return df.agg(F.count_distinct(column).alias("accounts"))


def account_sketches(df: DataFrame, column: str = "account") -> DataFrame:
    """Per month a sketch of its different values, which can be united over any range of months.

    A sketch has a bounded size; estimates are off by about 1.6 % (one standard deviation).
    """
    return df.groupBy("perf_month").agg(F.hll_sketch_agg(column, SKETCH_BITS).alias("accounts"))


def estimated_accounts(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Estimated number of different values over all sketches, or over those of each group; 0 where all values are NULL."""
    united = F.hll_sketch_estimate(F.hll_union_agg("accounts")).alias("accounts")
    return sketches.groupBy(*by).agg(united)


def global_sums(df: DataFrame, measures: Sequence[str] = MEASURES) -> DataFrame:
    """Sum of each measure over the whole frame, one row per measure."""
    sums = df.selectExpr(*sums_over(df.columns, measures))
    return sums.selectExpr(*[f"cast({settled(n)} as double) as {n}" for n in measures]).unpivot(
        [], list(measures), "measure", "total"
    )
