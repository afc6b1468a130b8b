"""Performance summary: a total line and one line per owner."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metrics
from ..functions.dates import MONTH_TEXT
from ..functions.scope import in_scope
from ..operators.ordered import indexed_within, sort_columns
from ..operators.totals import lines_with_totals
from ..schema import CPC_CUTOVER, TOTAL_LABEL, TOTAL_OWNER

_COLUMNS = (
    f"if(is_total = 1, '{TOTAL_LABEL}', asked) as ad_type",
    MONTH_TEXT,
    "spend",
    metrics.ACOS,
    "ad_revenue",
    "store_revenue",
    metrics.SPEND_SHARE,
    metrics.AD_REVENUE_SHARE,
    "store_profit",
    "non_ad_profit",
    "ad_profit",
    "clicks",
    *metrics.CLICK_RATIOS,
    f"if(is_total = 1, '{TOTAL_OWNER}', owner) as owner",
    "is_total",
)


# Total line first, then owners, within each month.
LINE_ORDER = ("perf_month", "is_total desc", "owner")


def line_order() -> list[Column]:
    return sort_columns([(name.removesuffix(" desc"), name.endswith(" desc")) for name in LINE_ORDER])


def summary_lines(
    df: DataFrame,
    ad_type: str,
    ym: str | None = None,
    cutover: str = CPC_CUTOVER,
    account: str | None = None,
) -> DataFrame:
    """Unordered summary with the ``is_total`` mark; every month when none is given."""
    lines = lines_with_totals(df.where(in_scope(ad_type, ym, None, account, cutover)))
    return lines.withColumn("asked", F.lit(ad_type)).selectExpr(*_COLUMNS)


def summary(df: DataFrame, ad_type: str, ym: str | None = None, cutover: str = CPC_CUTOVER) -> DataFrame:
    """Total line and owner lines in report order."""
    return summary_lines(df, ad_type, ym, cutover).orderBy(*line_order()).drop("is_total")


def indexed_summary(df: DataFrame, ad_type: str, ym: str | None = None, cutover: str = CPC_CUTOVER) -> DataFrame:
    """Summary with the line number of its month's report; the total line is 0."""
    lines = summary_lines(df, ad_type, ym, cutover)
    return indexed_within(lines, ["perf_month"], line_order()).orderBy("perf_month", "idx").drop("is_total")
