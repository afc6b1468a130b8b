"""Hand-made rows for the places where engines and formulas disagree."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from adtally.functions.casts import cast_cells
from adtally.functions import dates, metrics, money, scope, text
from adtally.operators import display, reshape, totals
from adtally.plans import detail, search, summary, trend

from .facts import fact_frame, rows_of

YM = "202103"


def value(spark, expression, **columns):
    frame = spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()])
    return frame.selectExpr(f"{expression} as v").first()["v"]


def test_ratios_of_zero_are_null(spark):
    facts = fact_frame(spark, {"clicks": 0, "spend": 0.0, "ad_revenue": 0.0, "store_revenue": 0.0, "store_profit": 0.0})
    line = rows_of(summary.summary(facts, "DIRECT", YM))[0]
    for name in ("acos", "spend_share", "ad_revenue_share", "cpc", "roi", "cr"):
        assert line[name] is None
    assert rows_of(detail.detail(facts, "DIRECT", YM, "ann"))[0]["ad_profit_share"] is None


@pytest.mark.parametrize(
    "number, rounded", [(0.125, 0.13), (-0.125, -0.13), (0.375, 0.38), (2.5, 2.5), (0.0, 0.0), (-1.5, -1.5)]
)
def test_round2_takes_halves_away_from_zero(spark, number, rounded):
    assert value(spark, money.round2("x"), x=number) == rounded


def test_percent_has_two_places_or_is_null(spark):
    assert value(spark, money.percent("a", "b"), a=1.0, b=8.0) == "12.50%"
    assert value(spark, money.percent("a", "b"), a=1.0, b=0.0) is None


@pytest.mark.parametrize("number, cut", [(2.7, 2), (-2.7, -2), (0.0, 0)])
def test_whole_cuts_towards_zero(spark, number, cut):
    assert value(spark, money.whole("x"), x=number) == cut


@pytest.mark.parametrize("amount, units", [(1.23456, 12346), (-1.23456, -12346), (0.00005, 1), (-0.00005, -1)])
def test_rounded_units_round_halves_away_from_zero(spark, amount, units):
    assert value(spark, money.rounded_units("x"), x=amount) == units


@pytest.mark.parametrize("amount, units", [(1.2345, 12345), (-0.1, -1000), (0.0, 0), (123456789.1234, 1234567891234), (9e13, 900_000_000_000_000_000)])
def test_to_units_keeps_amounts(spark, amount, units):
    assert value(spark, money.to_units("x"), x=amount) == units


@pytest.mark.parametrize("amount", [1e20, -1e20, float("nan"), float("inf"), 1.23456])
def test_amounts_that_fixed_point_cannot_hold_are_errors(spark, amount):
    with pytest.raises(Exception, match="does not fit fixed-point"):
        value(spark, money.to_units("x"), x=amount)


@pytest.mark.parametrize("cell, bad", [("1e20", 1), ("1.23456", 1), ("1.2345", 0), ("", 0), ("nan", 0), ("x", 1), ("9e13", 0)])
def test_report_cells_that_fixed_point_cannot_hold_are_bad(spark, cell, bad):
    rows = spark.createDataFrame([(cell,)], "c string")
    assert cast_cells(rows, {"c": "amount"}, {}).first()["bad_cells"] == bad


def test_sums_are_exact_beyond_bigint(spark):
    largest = 9_000_000_000_000_000_000
    facts = fact_frame(spark, {}, {}, {}).withColumn("spend", F.lit(largest))
    total = facts.selectExpr(*money.partial_sums(["spend"])).selectExpr(*money.settled_as(["spend"])).first()
    assert total["spend"] == 3 * largest / 10_000
    below = facts.withColumn("spend", -F.col("spend"))
    total = below.selectExpr(*money.partial_sums(["spend"])).selectExpr(*money.settled_as(["spend"])).first()
    assert total["spend"] == -3 * largest / 10_000


def test_rows_without_type_are_cpc_channel_but_outside_the_cpc_scope(spark):
    facts = fact_frame(spark, {"ad_type": None, "spend": 7.0}, {"ad_type": "AFFILIATE"})
    channels = {row["channel"]: row["spend"] for row in rows_of(totals.channel_month_totals(facts))}
    assert channels == {"CPC": 7.0, "AFFILIATE": 10.0}
    assert summary.summary(facts, "CPC", YM).count() == 0


def test_scope_before_and_after_the_cutover(spark):
    facts = fact_frame(
        spark,
        {"ad_type": "CPC", "perf_month": date(2021, 2, 1)},
        {"ad_type": "DIRECT", "perf_month": date(2021, 2, 1)},
        {"ad_type": "CPC"},
        {"ad_type": "DIRECT"},
        {"ad_type": "AFFILIATE"},
    )

    def types(**scoped):
        return sorted(row["ad_type"] for row in facts.where(scope.in_scope(**scoped)).collect())

    assert types(ad_type="CPC", ym="202102") == ["CPC"]
    assert types(ad_type="CPC", ym="202103") == ["CPC", "DIRECT"]
    assert types(ad_type="CPC") == ["CPC", "CPC", "DIRECT"]
    assert types(ad_type="DIRECT", ym="202103") == ["DIRECT"]


def test_owner_text_is_a_value_not_sql(spark):
    facts = fact_frame(spark, {"owner": "o' or '1'='1"}, {"owner": "other"})
    assert detail.detail(facts, "DIRECT", YM, "o' or '1'='1").count() == 2


def test_total_comes_first_also_beside_null_and_blank_owners(spark):
    facts = fact_frame(spark, {"owner": None}, {"owner": ""}, {"owner": "zoe"})
    lines = rows_of(summary.summary(facts, "DIRECT", YM))
    assert [(line["ad_type"], line["owner"]) for line in lines] == [
        ("TOTAL", ""),
        ("DIRECT", None),
        ("DIRECT", ""),
        ("DIRECT", "zoe"),
    ]
    indexed = rows_of(summary.indexed_summary(facts, "DIRECT", YM))
    assert [line["idx"] for line in indexed] == [0, 1, 2, 3]
    assert indexed[0]["ad_type"] == "TOTAL"


def test_trend_aligns_channels_by_month(spark):
    facts = fact_frame(
        spark,
        {"spend": 2.7, "ad_revenue": 10.9},
        {"perf_month": date(2021, 4, 1), "spend": 3.0, "ad_revenue": 9.0},
        {"perf_month": date(2021, 4, 1), "ad_type": "AFFILIATE", "spend": 1.0, "ad_revenue": 7.0},
    )
    march, april = rows_of(trend.monthly_trend(facts))
    assert (march["perf_month"], april["perf_month"]) == ("2021-03", "2021-04")
    assert march["affiliate_roi"] is None and march["affiliate_ad_revenue"] is None
    assert march["cpc_roi"] == 10 / 2 and march["total_ad_revenue"] == 10
    assert april["affiliate_roi"] == 7.0 and april["total_roi"] == 16 / 4


def test_empty_selection(spark):
    facts = fact_frame(spark, {})
    assert summary.summary(facts, "DIRECT", "199901").count() == 0
    lines = rows_of(detail.detail(facts, "DIRECT", "199901", "ann"))
    assert len(lines) == 1 and lines[0]["ad_type"] == "TOTAL"
    assert all(v is None for k, v in lines[0].items() if k != "ad_type")


def test_detail_keeps_the_optional_column(spark):
    facts = fact_frame(spark, {}).withColumn("gross_margin_delta", F.lit(25_000).cast("bigint"))
    total, row = rows_of(detail.detail(facts, "DIRECT", YM, "ann"))
    assert total["gross_margin_delta"] is None and row["gross_margin_delta"] == 2.5
    assert total["account"] is None and total["spend"] == row["spend"] == 10.0


@pytest.mark.parametrize(
    "number, shown",
    [
        (100.0, "100.0"),
        (100.01, "100"),
        (-100.01, "-100"),
        (12.5, "12.5"),
        (0.0, "0.0"),
        (0.0005, "0.0005"),
        (123456789012.75, "123456789012"),
    ],
)
def test_display_rule(spark, number, shown):
    assert value(spark, display.display_text("x"), x=number) == shown


def test_display_of_nulls_and_names_that_start_with_n(spark):
    frame = spark.createDataFrame([("nanna", None, 7), (None, 150.5, 250)], "account string, spend double, clicks bigint")
    shown = rows_of(display.display_format(frame, ["spend", "clicks"]))
    assert shown[0] == {"account": "nanna", "spend": "", "clicks": "7"}
    assert shown[1] == {"account": "", "spend": "150", "clicks": "250"}


def test_site_marks_count_in_any_case(spark):
    sites = spark.createDataFrame([("A-TH",), ("b-ph",), ("c-My",), ("d-sg",), (None,)], "site string")
    assert [r["site"] for r in sites.where(text.is_uploaded_site("site")).collect()] == ["A-TH", "b-ph", "c-My"]
    assert value(spark, text.shop_of_site("x"), x="shop-th") == "shop"


def test_month_texts(spark):
    day = date(2021, 1, 31)
    assert value(spark, dates.previous_month_key("x"), x=day) == "202012"
    assert value(spark, dates.month_key("x"), x=day) == "202101"
    assert value(spark, dates.month_text("x"), x=day) == "2021-01"
    assert value(spark, dates.load_stamp("x"), x=day) == "210131"
    assert value(spark, text.short_period("x"), x=day) == "210131"
    assert (dates.month_start("202112"), dates.month_after("202112")) == (date(2021, 12, 1), date(2022, 1, 1))


def test_search_uses_the_newest_month_and_the_account_text(spark):
    facts = fact_frame(
        spark,
        {"perf_month": date(2021, 2, 1), "owner": "old"},
        {"owner": "ann", "account": "alpha-th"},
        {"owner": "bob", "account": "beta-th"},
    )
    assert [line["owner"] for line in rows_of(search.search(facts))] == ["", "ann", "bob"]
    assert [line["owner"] for line in rows_of(search.search(facts, account="beta"))] == ["", "bob"]
    rows = rows_of(search.search(facts, owner="ann"))
    assert [row["account"] for row in rows] == [None, "alpha-th"]
    assert rows[1]["cpc"] == 1.25 and "clicks" in rows[1]


def test_unpivot_keeps_periods_apart_and_names_missing_categories(spark):
    wide = spark.createDataFrame(
        [("a", 1500.9, 0.0), ("a", 600.9, None), (None, 0.0, 1001.0), ("b", 1000.0, -5.0)],
        "category_name string, p1_sales double, p2_sales double",
    )
    long = rows_of(reshape.unpivot_totals(wide, "category_name", ["p1_sales", "p2_sales"], 1000, "_sales"))
    assert long == [
        {"category": "a", "period": "p1", "total": 2100},
        {"category": "OTHER", "period": "p2", "total": 1001},
    ]
    with pytest.raises(ValueError):
        reshape.unpivot_totals(wide.withColumn("p1", F.lit(1.0)), "category_name", ["p1", "p1_sales"], 0, "_sales")


def test_distinct_accounts_and_months(spark):
    facts = fact_frame(spark, {}, {"account": None}, {"account": "b"}, {"perf_month": date(2020, 12, 1)})
    assert totals.distinct_accounts(facts).first()["accounts"] == 2
    assert [r["perf_month"] for r in totals.month_list(facts).collect()] == ["2021-03", "2020-12"]
    assert [r["perf_month"] for r in totals.month_list(facts, False).collect()] == ["2020-12", "2021-03"]
    assert totals.latest_month(facts).first()["latest_month"] == "202103"


def test_metric_formulas(spark):
    facts = fact_frame(spark, {})
    row = totals.group_totals(facts, ["owner"]).selectExpr(
        metrics.ACOS, metrics.SPEND_SHARE, metrics.AD_REVENUE_SHARE, metrics.AD_PROFIT_SHARE, *metrics.CLICK_RATIOS
    ).first()
    assert tuple(row) == ("25.00%", "10.00%", "40.00%", "20.00%", 1.25, 4.0, 0.38)
