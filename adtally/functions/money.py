"""Fixed-point money: conversion, exact sums, rounding and ratios."""

from __future__ import annotations

from collections.abc import Iterable

from ..schema import MONEY, MONEY_UNITS

# A sum of money is carried as two bigints, high and low bits of the amounts,
# so that neither can overflow below eight trillion rows.
_LOW_BITS = 20
_LOW_MASK = (1 << _LOW_BITS) - 1


# Amounts beyond it don't fit a bigint of 1/10,000 of the unit; a double's own error grows with the amount.
LARGEST = 9.2e14
_OWN_ERROR = "greatest(0.001D, abs({}) * 1e-12D)"


def rounded_units(amount: str, units: int = MONEY_UNITS) -> str:
    """Currency amount (double or decimal) to fixed-point, halves away from zero."""
    scaled = f"(cast({amount} as double) * {units})"
    return f"if({scaled} < 0, -floor(0.5D - {scaled}), floor({scaled} + 0.5D))"


def representable(amount: str, units: int = MONEY_UNITS) -> str:
    """Whether an amount is finite, below 9.2e14 in size, and has no more places than fixed-point."""
    value = f"cast({amount} as double)"
    scaled = f"({value} * {units})"
    exact = f"abs({scaled} - round({scaled})) <= {_OWN_ERROR.format(scaled)}"
    return f"(not isnan({value}) and abs({value}) < {LARGEST:.1e}D and {exact})"


def to_units(amount: str, units: int = MONEY_UNITS) -> str:
    """``rounded_units`` of an amount that can be held exactly; any other amount ends the job with an error."""
    refused = f"raise_error(concat('amount {amount.replace(chr(39), '')} of ', cast({amount} as string), ' does not fit fixed-point'))"
    return f"case when ({amount}) is null then null when {representable(amount, units)} then {rounded_units(amount, units)} else {refused} end"


def in_currency(units: str) -> str:
    """Fixed-point as double currency."""
    return f"(cast({units} as double) / {MONEY_UNITS}D)"


def partial_sums(measures: Iterable[str], when: str | None = None, prefix: str = "") -> list[str]:
    """Aggregates that hold exact partial sums of measures, optionally of matching rows only."""
    parts = []
    for name in measures:
        value = f"`{name}`" if when is None else f"if({when}, `{name}`, null)"
        if name in MONEY:
            parts.append(f"sum(shiftright({value}, {_LOW_BITS})) as `{prefix}{name}__high`")
            parts.append(f"sum({value} & {_LOW_MASK}L) as `{prefix}{name}__low`")
        else:
            parts.append(f"sum({value}) as `{prefix}{name}`")
    return parts


def sums_over(columns: Iterable[str], measures: Iterable[str], when: str | None = None, prefix: str = "") -> list[str]:
    """``partial_sums`` over fact rows, or over rows that hold partial sums already."""
    held, parts = set(columns), []
    for name in measures:
        if f"{name}__high" not in held:
            parts += partial_sums([name], when, prefix)
            continue
        for half in (f"{name}__high", f"{name}__low"):
            value = f"`{half}`" if when is None else f"if({when}, `{half}`, null)"
            parts.append(f"sum({value}) as `{prefix}{half}`")
    return parts


def merged_sums(measures: Iterable[str], prefix: str = "") -> list[str]:
    """Aggregates that add up partial sums of finer groups."""
    names = []
    for name in measures:
        names += [f"{prefix}{name}__high", f"{prefix}{name}__low"] if name in MONEY else [f"{prefix}{name}"]
    return [f"sum(`{name}`) as `{name}`" for name in names]


def settled(name: str, prefix: str = "") -> str:
    """Final value of a partial sum: money as double currency, counts as they are."""
    if name not in MONEY:
        return f"`{prefix}{name}`"
    high = f"cast(`{prefix}{name}__high` as decimal(20,0))"
    low = f"cast(`{prefix}{name}__low` as decimal(20,0))"
    return f"cast(({high} * {1 << _LOW_BITS}BD + {low}) * {1 / MONEY_UNITS:.4f}BD as double)"


def settled_as(measures: Iterable[str]) -> list[str]:
    return [f"{settled(name)} as `{name}`" for name in measures]


def round2(value: str) -> str:
    """Two places, halves away from zero, on the double itself."""
    return f"(sign({value}) * floor(abs({value}) * 100D + 0.5D) / 100D)"


def whole(value: str) -> str:
    """Whole units, fraction cut off towards zero."""
    return f"cast(sign({value}) * floor(abs({value})) as bigint)"


def ratio(numerator: str, denominator: str) -> str:
    """Quotient as double; NULL where the denominator is zero."""
    return f"try_divide(cast({numerator} as double), cast({denominator} as double))"


def percent(numerator: str, denominator: str) -> str:
    """Quotient as text with two places and a percent sign; NULL where it is undefined."""
    share = round2(f"try_divide(100D * cast({numerator} as double), cast({denominator} as double))")
    return f"concat(cast(cast({share} as decimal(38,2)) as string), '%')"
