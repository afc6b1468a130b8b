"""Drill-down to the fact rows of an owner, with a total line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from ..functions import metrics
from ..functions.dates import MONTH_TEXT
from ..functions.money import in_currency, partial_sums, settled_as
from ..functions.scope import in_scope
from ..operators.ordered import indexed, sort_columns
from ..schema import CPC_CUTOVER, MEASURES, MONEY, OPTIONAL_MONEY, TOTAL_LABEL
from ..sources.fact import further

_COLUMNS = (
    "ad_type",
    "account",
    MONTH_TEXT,
    "spend",
    metrics.ACOS,
    "ad_revenue",
    "store_revenue",
    metrics.SPEND_SHARE,
    "store_profit",
    "non_ad_profit",
    "ad_profit",
    metrics.AD_PROFIT_SHARE,
    metrics.AD_REVENUE_SHARE,
    "ad_orders",
    "clicks",
    "owner",
)


# Order of lines, pages and line numbers: total line first, then rows by account.
LINE_ORDER = ("is_total desc", "account", "perf_month", "ad_type")


def line_order() -> list[Column]:
    return sort_columns([(name.removesuffix(" desc"), name.endswith(" desc")) for name in LINE_ORDER])


def _or_null(name: str, shared: str | None) -> str:
    return f"coalesce({name}, '{TOTAL_LABEL}')" if shared else f"'{TOTAL_LABEL}'"


def detail_lines(
    df: DataFrame,
    ad_type: str,
    ym: str | None = None,
    owner: str | None = None,
    cutover: str = CPC_CUTOVER,
    account: str | None = None,
    ratios: tuple[str, ...] = (),
) -> DataFrame:
    """Total line and rows, unordered, with the ``is_total`` mark and further ratios.

    The total line has no account and stands even when no row matches.  Columns
    that the data model doesn't name follow the others; the total has none.

    An owner's rows are few beside all facts, so they are dealt out once and
    the total is taken from the same exchange as the rows: facts are scanned once.
    """
    scoped = df.where(in_scope(ad_type, ym, owner, account, cutover))
    if owner:
        scoped = scoped.hint("rebalance")
    optional = [name for name in OPTIONAL_MONEY if name in df.columns]
    others = [f"`{name}`" for name in further(df)]
    kinds = {f"`{name}`": df.schema[name].dataType.simpleString() for name in further(df)}
    carried = ["ad_type", "account", "perf_month", "owner"]
    amounts = [f"{in_currency(n)} as {n}" if n in MONEY else n for n in MEASURES]
    rows = scoped.selectExpr(
        *carried, *amounts, *[f"{in_currency(n)} as {n}" for n in optional], *others, "0 as is_total"
    )
    # Never true: the sums ask for the same columns as the rows do, or they couldn't share the exchange.
    unshown = [f"if(count(*) < 0, any_value({n}), null) as {n}" for n in ("ad_type", "account", *optional, *others)]
    total = scoped.selectExpr(
        "min(perf_month) as perf_month", "min(owner) as owner", *partial_sums(MEASURES), *(unshown if owner else [])
    ).selectExpr(
        f"{_or_null('ad_type', owner)} as ad_type",
        f"{'account' if owner else 'cast(null as string)'} as account",
        "perf_month",
        "owner",
        *settled_as(MEASURES),
        *[f"{f'cast({n} as double)' if owner else 'cast(null as double)'} as {n}" for n in optional],
        *[f"{n if owner else f'cast(null as {kinds[n]})'} as {n}" for n in others],
        "1 as is_total",
    )
    return total.unionByName(rows).selectExpr(*_COLUMNS, *optional, *ratios, *others, "is_total")


def detail(df: DataFrame, ad_type: str, ym: str, owner: str, cutover: str = CPC_CUTOVER) -> DataFrame:
    """Total line first, then the owner's rows by account."""
    return detail_lines(df, ad_type, ym, owner, cutover).orderBy(*line_order()).drop("is_total")


def indexed_detail(df: DataFrame, ad_type: str, ym: str, owner: str, cutover: str = CPC_CUTOVER) -> DataFrame:
    """Detail with its line number; the total line is 0."""
    return indexed(detail_lines(df, ad_type, ym, owner, cutover), LINE_ORDER).drop("is_total")
