"""Upload ingest: one KPI row per site out of ad reports and store dashboards.

All sites are one job.  Both inputs are summed or held per key before they
meet, so the join needs no further shuffle and a site with very many report
rows arrives as one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import load_stamp
from ..functions.money import ratio, round2, settled_as, sums_over
from ..operators.totals import aggregated
from ..schema import DASHBOARD_CELLS, KPI_NAMES, REPORT_COUNTS, REPORT_MONEY

DEFAULT_KEYS = ("account",)
_SUMMED = (*REPORT_MONEY.values(), *REPORT_COUNTS.values())


def _marks(reports: DataFrame) -> tuple[str, str]:
    bad = "sum(bad_cells)" if "bad_cells" in reports.columns else "0L"
    return bad, "max(missing_headers)" if "missing_headers" in reports.columns else "0"


def summed_reports(reports: DataFrame, keys: Sequence[str] = DEFAULT_KEYS) -> DataFrame:
    """Report rows added up by site and placement, in a form that stands for the rows in all further sums."""
    bad, missing = _marks(reports)
    marks = [f"{bad} as bad_cells", f"{missing} as missing_headers"]
    return aggregated(reports, [*keys, "placement"], [*sums_over(reports.columns, _SUMMED), *marks])


def report_sums(
    reports: DataFrame, keys: Sequence[str] = DEFAULT_KEYS, placement: str | None = None
) -> DataFrame:
    """Sums of the ad columns per site, of all placements or one, and the site's number of bad cells.

    A bad cell in any placement counts.  Sites without the placement give no row.
    """
    bad, missing = _marks(reports)
    results = [*keys, *settled_as(_SUMMED), "bad_report", "missing_headers", "true as has_report"]
    marks = [f"{bad} as bad_report", f"{missing} as missing_headers"]
    if placement is None:
        return aggregated(reports, keys, [*sums_over(reports.columns, _SUMMED), *marks], results)
    rows = reports.withColumn("placed", F.col("placement") == placement)
    aggregates = [*sums_over(reports.columns, _SUMMED, "placed"), *marks, "bool_or(placed) as has_placement"]
    return aggregated(rows, keys, aggregates, [*results, "has_placement"]).where("has_placement").drop("has_placement")


def _dashboards(dashboards: DataFrame, keys: Sequence[str]) -> DataFrame:
    bad = "bad_cells" if "bad_cells" in dashboards.columns else "0"
    return dashboards.selectExpr(*keys, *DASHBOARD_CELLS, f"{bad} as bad_dashboard", "true as has_dashboard")


def renamed_kpis(df: DataFrame) -> DataFrame:
    """KPI table names in place of the report and dashboard names."""
    return df.withColumnsRenamed(KPI_NAMES)


def site_kpis(
    reports: DataFrame,
    dashboards: DataFrame,
    load_date: str = "current_date()",
    keys: Sequence[str] = DEFAULT_KEYS,
    placement: str | None = None,
) -> DataFrame:
    """KPI row of every site that has a readable report and a readable dashboard.

    Revenue is rounded before the ratios are taken, spend is not.  ``load_date``
    is SQL text.
    """
    sums = report_sums(reports, keys, placement).where("bad_report = 0 and missing_headers = 0")
    boards = _dashboards(dashboards, keys).where("bad_dashboard = 0")
    sites = renamed_kpis(sums.join(boards, list(keys)))
    rounded = {name: F.expr(round2(name)) for name in ("Revenue", "account_Revenue")}
    return sites.withColumns(rounded).selectExpr(
        *keys,
        *KPI_NAMES.values(),
        f"{round2(ratio('Units_Sold', 'Clicks'))} as unit_cr",
        f"{round2(ratio('Spend', 'Clicks'))} as cpc",
        f"{round2(ratio('Revenue', 'Spend'))} as roi",
        f"{load_stamp(load_date)} as update_time",
    )


def placement_kpis(
    reports: DataFrame,
    dashboards: DataFrame,
    placement: str,
    load_date: str = "current_date()",
    keys: Sequence[str] = DEFAULT_KEYS,
) -> DataFrame:
    """KPI rows of the ads of one placement."""
    return site_kpis(reports, dashboards, load_date, keys, placement)


def rejects(reports: DataFrame, dashboards: DataFrame, keys: Sequence[str] = DEFAULT_KEYS) -> DataFrame:
    """Sites left out of the KPI table and why."""
    sites = report_sums(reports, keys).join(_dashboards(dashboards, keys), list(keys), "full_outer")
    reason = """case when has_report is null then 'no ad report'
        when has_dashboard is null then 'no dashboard'
        when missing_headers > 0 then 'missing column in ad report'
        when bad_report > 0 then 'bad value in ad report'
        when bad_dashboard > 0 then 'bad value in dashboard' end"""
    return sites.selectExpr(*keys, f"{reason} as reason").where("reason is not null")
