"""Text keys cut out of site names, titles and column names."""

from __future__ import annotations

from ..schema import SITE_MARKS


def shop_of_site(site: str) -> str:
    """A site's shop: its name without the last three characters."""
    return f"substring({site}, 1, length({site}) - 3)"


def is_uploaded_site(site: str) -> str:
    """Sites of the marketplaces that take part in an upload, in any case."""
    return "(" + " or ".join(f"contains(lower({site}), '{mark}')" for mark in SITE_MARKS) + ")"


def prefix_before(text: str, mark: str) -> str:
    """Text up to the first mark, all of it where there is none."""
    return f"substring_index({text}, '{mark}', 1)"


def whole_part(text: str) -> str:
    """Digits before the decimal point."""
    return prefix_before(text, ".")


def short_period(month: str) -> str:
    """``YYMMDD`` of a date, taken from its text as ``YYYY-MM-DD``."""
    return f"replace(substring(cast({month} as string), 3, 8), '-', '')"
