"""Casts of landed text cells that mark bad values instead of failing."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from .money import representable, rounded_units


def money_cell(text: str) -> tuple[str, str]:
    """Fixed-point amount and whether the cell is bad; an empty cell is no amount, nothing bad.

    A number that fixed-point can't hold (9.2e14 or more, or more than four
    places) is bad, as is text.
    """
    number = f"try_cast({text} as double)"
    held = f"if(coalesce({representable(number)}, false), {number}, null)"
    empty = f"(({text}) is null or lower(trim({text})) in ('', 'nan'))"
    return f"if({empty}, 0L, {rounded_units(held)})", f"(not {empty} and {held} is null)"


def count_cell(text: str) -> tuple[str, str]:
    """Whole number and whether the cell is bad; an empty cell is bad."""
    number = f"try_cast({text} as bigint)"
    return number, f"({number} is null)"


def cast_cells(
    df: DataFrame, money: Mapping[str, str], counts: Mapping[str, str], keep: tuple[str, ...] = ()
) -> DataFrame:
    """Typed columns from text columns, and the number of bad cells of the row as ``bad_cells``."""
    cells = {new: money_cell(f"`{old}`") for old, new in money.items()}
    cells |= {new: count_cell(f"`{old}`") for old, new in counts.items()}
    bad = " + ".join(f"int({mark})" for _, mark in cells.values())
    return df.selectExpr(*keep, *[f"{value} as {name}" for name, (value, _) in cells.items()], f"{bad} as bad_cells")
