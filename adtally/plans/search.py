"""Paged search over summaries and details."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..functions import metrics
from ..operators.display import display_format, page_json_records
from ..operators.ordered import page
from ..operators.totals import newest_month_rows
from ..schema import PAGE_SIZE, SEARCH_AD_TYPE
from . import detail, summary

# A cut-over that no month reaches.
NEVER = "999912"


def search_summary_lines(
    df: DataFrame, ad_type: str, ym: str | None = None, account: str | None = None
) -> DataFrame:
    """Summary without clicks, with the ``is_total`` mark; types are always taken as they are."""
    return summary.summary_lines(df, ad_type, ym, NEVER, account).drop("clicks")


def search_summary(df: DataFrame, ad_type: str, ym: str) -> DataFrame:
    return search_summary_lines(df, ad_type, ym).orderBy(*summary.line_order()).drop("is_total")


def search_detail_lines(
    df: DataFrame, ad_type: str, ym: str | None, owner: str, account: str | None = None
) -> DataFrame:
    """Detail with the click ratios of each row and of the total."""
    return detail.detail_lines(df, ad_type, ym, owner, NEVER, account, metrics.CLICK_RATIOS)


def search_detail(df: DataFrame, ad_type: str, ym: str, owner: str, account: str | None = None) -> DataFrame:
    return search_detail_lines(df, ad_type, ym, owner, account).orderBy(*detail.line_order()).drop("is_total")


def search(
    df: DataFrame,
    ad_type: str = SEARCH_AD_TYPE,
    ym: str | None = None,
    owner: str | None = None,
    account: str | None = None,
    offset: int = 0,
    limit: int = PAGE_SIZE,
) -> DataFrame:
    """One page: the summary, or the rows of an owner.

    Without a month it is the newest one.  ``account`` keeps the rows of
    accounts that hold the text.
    """
    lines, order = _lines(df, ad_type, ym, owner, account)
    return page(lines, order, offset, limit).drop("is_total")


def search_json(
    df: DataFrame,
    ad_type: str = SEARCH_AD_TYPE,
    ym: str | None = None,
    owner: str | None = None,
    account: str | None = None,
    offset: int = 0,
    limit: int = PAGE_SIZE,
) -> DataFrame:
    """The page as display texts in JSON, each with the size of the whole result."""
    lines, order = _lines(df, ad_type, ym, owner, account)
    return page_json_records(lines, order, offset, limit, _shown)


def _shown(rows: DataFrame) -> DataFrame:
    rows = rows.drop("is_total")
    numbers = [name for name, kind in rows.dtypes if kind in ("double", "bigint")]
    return display_format(rows, numbers)


def _lines(
    df: DataFrame, ad_type: str, ym: str | None, owner: str | None, account: str | None
) -> tuple[DataFrame, Sequence[str]]:
    if ym is None:
        df = newest_month_rows(df)
    if owner:
        return search_detail_lines(df, ad_type, ym, owner, account), detail.LINE_ORDER
    return search_summary_lines(df, ad_type, ym, account), summary.LINE_ORDER
