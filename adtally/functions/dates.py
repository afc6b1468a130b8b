"""Month keys: range predicates that reach the scan, and month texts."""

from __future__ import annotations

from datetime import date


def month_start(ym: str) -> date:
    """First day of a ``YYYYMM`` month."""
    return date(int(ym[:4]), int(ym[4:6]), 1)


def month_after(ym: str) -> date:
    start = month_start(ym)
    return date(start.year + start.month // 12, start.month % 12 + 1, 1)


def in_month(column: str, ym: str) -> str:
    """Half-open range test, so that parquet statistics and partitions can be used."""
    return f"({column} >= date'{month_start(ym)}' and {column} < date'{month_after(ym)}')"


def month_key(column: str) -> str:
    """``YYYYMM``."""
    return f"date_format({column}, 'yyyyMM')"


def month_text(column: str) -> str:
    """``YYYY-MM``."""
    return f"substring(cast(cast({column} as date) as string), 1, 7)"


MONTH_TEXT = f"{month_text('perf_month')} as perf_month"


def previous_month_key(column: str) -> str:
    """``YYYYMM`` of the month before."""
    return f"date_format(add_months({column}, -1), 'yyyyMM')"


def load_stamp(day: str = "current_date()") -> str:
    """``YYMMDD``: the last six characters of the load date."""
    return f"right(date_format({day}, 'yyyyMMdd'), 6)"
