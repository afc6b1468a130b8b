"""Which fact rows a report covers.  Values asked for by a user are literals, never SQL text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import AFFILIATE, CPC, CPC_CUTOVER
from .dates import in_month, month_start

# Affiliate or CPC; rows without a type count as CPC.
CHANNEL = f"if(ad_type = '{AFFILIATE}', '{AFFILIATE}', '{CPC}')"


def scope_type(ad_type: str, ym: str | None = None, cutover: str = CPC_CUTOVER) -> Column:
    """Ad-type test of a report.

    ``CPC`` means every type but affiliate from the cut-over month on and the
    plain type before it.  Without a month the test is made row by row.  Rows
    without a type pass neither form.
    """
    if ad_type != CPC:
        return F.col("ad_type") == ad_type
    paid, exact = f"ad_type <> '{AFFILIATE}'", f"ad_type = '{CPC}'"
    if ym is not None:
        return F.expr(paid if int(ym) >= int(cutover) else exact)
    late = f"perf_month >= date'{month_start(cutover)}'"
    return F.expr(f"({late} and {paid}) or (not {late} and {exact})")


def in_scope(
    ad_type: str,
    ym: str | None = None,
    owner: str | None = None,
    account: str | None = None,
    cutover: str = CPC_CUTOVER,
) -> Column:
    """Type, month, owner and account-text tests of a report in one predicate."""
    test = scope_type(ad_type, ym, cutover)
    if ym is not None:
        test = test & F.expr(in_month("perf_month", ym))
    if owner:
        test = test & (F.col("owner") == owner)
    if account:
        test = test & F.col("account").contains(account)
    return test


def owner_like(pattern: str) -> Column:
    return F.col("owner").like(pattern)
