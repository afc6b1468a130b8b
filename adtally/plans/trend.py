"""Monthly channel trend."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.dates import MONTH_TEXT
from ..functions.money import ratio, round2, settled, sums_over, whole
from ..functions.scope import CHANNEL
from ..operators.totals import aggregated
from ..schema import AFFILIATE, CPC

_SERIES = {"cpc": CPC, "affiliate": AFFILIATE}
_PAIR = ("spend", "ad_revenue")


def monthly_trend(df: DataFrame, shown: bool = False) -> DataFrame:
    """Per month: whole-unit spend and revenue of both channels and together, and the three ROIs.

    Channels are aligned by month.  A channel without rows in a month has no
    values of its own there and counts as nothing in the total.  ``shown``
    rounds the ROIs to two places.
    """
    sums, cut = [], []
    for series, code in _SERIES.items():
        sums += sums_over(df.columns, _PAIR, f"{CHANNEL} = '{code}'", f"{series}_")
        cut += [f"{whole(settled(name, f'{series}_'))} as {series}_{name}" for name in _PAIR]
    totals = [f"{' + '.join(f'coalesce({s}_{name}, 0)' for s in _SERIES)} as total_{name}" for name in _PAIR]
    months = aggregated(df, ["perf_month"], sums, [MONTH_TEXT, *cut]).selectExpr("*", *totals)
    rois = []
    for series in ("total", *_SERIES):
        roi = ratio(f"{series}_ad_revenue", f"{series}_spend")
        rois.append(f"{round2(roi) if shown else roi} as {series}_roi")
    return months.selectExpr("*", *rois).orderBy("perf_month")
