"""What the plans look like, and properties that hold for any data."""

import pytest
from pyspark.sql import functions as F

from checks.queries import CUTOVER, OWNER, QUERIES, SUMMARY_NEEDS, YM
from adtally.plans import detail, search, summary
from adtally.sources.warehouse import ad_base, table

from .facts import fact_frame

SF_DIR = "/root/testdata/sf0.01"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_summary_scans_the_facts_once(spark):
    for name in ("summary_cpc", "summary_type", "indexed_summary", "search_summary"):
        assert plan_of(QUERIES[name](spark, SF_DIR)).count("lineitem.parquet") == 1


def test_month_reaches_the_scan_as_a_range(spark):
    for name in ("summary_cpc", "detail_owner", "month_extract", "filter_month", "search_page"):
        plan = plan_of(QUERIES[name](spark, SF_DIR))
        assert "GreaterThanOrEqual(l_shipdate,1998-03-01" in plan and "LessThan(l_shipdate,1998-04-01" in plan


def test_dimensions_are_read_only_where_asked_for(spark):
    for name in ("monthly_trend", "channel_month_totals", "scope_total", "global_sums"):
        plan = plan_of(QUERIES[name](spark, SF_DIR))
        assert "supplier" not in plan and "nation" not in plan
    assert "nation" not in plan_of(QUERIES["metric_acos"](spark, SF_DIR))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_and_no_pair_plans(spark, name):
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    for node in ("Python", "ArrowEval", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in plan


def test_near_page_is_a_bounded_top_k(spark):
    assert "TakeOrderedAndProject(limit=30, offset=15" in plan_of(QUERIES["search_page"](spark, SF_DIR))


def test_keys_of_described_tables_are_unique(spark):
    for name, key in (("supplier", "s_suppkey"), ("nation", "n_nationkey")):
        rows = table(spark, SF_DIR, name)
        assert rows.count() == rows.select(key).distinct().count()


def test_total_line_is_the_sum_of_the_owner_lines(spark):
    lines = summary.summary_lines(ad_base(spark, SF_DIR, SUMMARY_NEEDS), "CPC", None, CUTOVER)
    names = ["spend", "ad_revenue", "store_revenue", "store_profit", "non_ad_profit", "ad_profit", "clicks"]
    sums = lines.groupBy("perf_month").agg(
        *[F.sum(F.when(F.col("is_total") == 1, F.col(n)).otherwise(-F.col(n))).alias(n) for n in names]
    )
    for row in sums.collect():
        assert all(abs(row[n]) < 1e-4 for n in names)


def test_detail_total_is_the_owners_summary_line(spark):
    facts = ad_base(spark, SF_DIR, ym=YM)
    total = detail.detail(facts, "CPC", YM, OWNER, CUTOVER).first()
    line = summary.summary(facts, "CPC", YM, CUTOVER).where(F.col("owner") == OWNER).first()
    for name in ("spend", "acos", "ad_revenue", "store_revenue", "spend_share", "ad_profit", "clicks"):
        assert total[name] == line[name]


def test_search_pages_make_up_the_search(spark):
    facts = ad_base(spark, SF_DIR, SUMMARY_NEEDS, YM)
    pages = []
    for offset in (0, 15, 30):
        pages += search.search(facts, "DIRECT", YM, offset=offset).collect()
    assert pages == search.search_summary(facts, "DIRECT", YM).collect()


def test_reports_are_in_order(spark):
    lines = QUERIES["summary_cpc_all_months"](spark, SF_DIR).collect()
    keys = [(line["perf_month"], line["ad_type"] != "TOTAL", line["owner"]) for line in lines]
    assert keys == sorted(keys)
    months = [row["perf_month"] for row in QUERIES["monthly_trend"](spark, SF_DIR).collect()]
    assert months == sorted(months)
    totals = [(r["perf_month"], r["channel"]) for r in QUERIES["channel_month_totals"](spark, SF_DIR).collect()]
    assert totals == sorted(totals)
    numbers = [row["idx"] for row in QUERIES["indexed_detail"](spark, SF_DIR).orderBy("idx").collect()]
    assert numbers == list(range(len(numbers)))


def test_a_hot_supplier_is_split_over_tasks(spark, tmp_path):
    """A third of the lines under one supplier, with no side small enough to broadcast."""
    hot = F.when(F.col("l_orderkey") % 3 == 0, 5).otherwise(F.col("l_suppkey")).cast("bigint")
    lines = table(spark, SF_DIR, "lineitem").withColumn("l_suppkey", hot)
    lines.repartition(8).write.parquet(f"{tmp_path}/lineitem.parquet")
    for name in ("supplier", "nation"):
        table(spark, SF_DIR, name).write.parquet(f"{tmp_path}/{name}.parquet")
    settings = {
        "spark.sql.shuffle.partitions": "32",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50k",
    }
    expected = sorted(map(tuple, QUERIES["fact_scan"](spark, str(tmp_path)).collect()), key=str)
    before = {name: spark.conf.get(name, None) for name in settings}
    try:
        for name, setting in settings.items():
            spark.conf.set(name, setting)
        lines = QUERIES["fact_scan"](spark, str(tmp_path))
        assert sorted(map(tuple, lines.collect()), key=str) == expected
        assert "SortMergeJoin(skew=true)" in plan_of(lines)
    finally:
        for name, setting in before.items():
            spark.conf.unset(name) if setting is None else spark.conf.set(name, setting)


def test_pages_json_does_not_gather_rows_for_the_count(spark):
    plan = plan_of(QUERIES["page_json_records"](spark, SF_DIR))
    assert "rangepartitioning" not in plan and "TakeOrderedAndProject(limit=15" in plan


def test_detail_is_in_order_however_it_is_stored(spark):
    facts = ad_base(spark, SF_DIR, ym=YM, further=("l_orderkey",))
    for report in (
        lambda df: detail.detail(df, "CPC", YM, OWNER, CUTOVER),
        lambda df: search.search_detail(df, "DIRECT", YM, OWNER),
    ):
        lines = report(facts).collect()
        keys = [(r["ad_type"] != "TOTAL", r["account"] or "") for r in lines]
        assert len(lines) > 2 and keys == sorted(keys) and keys[0][0] is False
        again = [(r["ad_type"] != "TOTAL", r["account"] or "") for r in report(facts.repartition(7, F.rand(1))).collect()]
        assert again == keys


def test_further_columns_reach_the_reports(spark):
    facts = ad_base(spark, SF_DIR, ym=YM, further=("l_orderkey", "l_linestatus"))
    lines = detail.detail(facts, "CPC", YM, OWNER, CUTOVER)
    assert lines.columns[-2:] == ["l_orderkey", "l_linestatus"]
    total, first = lines.take(2)
    assert total["l_orderkey"] is None and first["l_orderkey"] is not None


def test_upsert_computes_what_arrives_once(spark):
    """Incoming rows are read from their own table, so the plan scans the lines only for the current rows."""
    plan = plan_of(QUERIES["site_upsert_all_months"](spark, SF_DIR))
    assert plan.count("lineitem.parquet") <= 2


def test_sums_meet_the_suppliers(spark):
    """Without broadcast, the lines are summed before they are shuffled to the suppliers."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    before = {name: spark.conf.get(name, None) for name in settings}
    try:
        for name, setting in settings.items():
            spark.conf.set(name, setting)
        for name in ("summary_cpc_all_months", "owner_breakdown", "metric_acos"):
            plan = plan_of(QUERIES[name](spark, SF_DIR))
            scan = plan.index("lineitem.parquet")
            assert "partial_sum" in plan[plan.rindex("SortMergeJoin", 0, scan) : scan]
    finally:
        for name, setting in before.items():
            spark.conf.unset(name) if setting is None else spark.conf.set(name, setting)


def test_first_rows_are_picked_before_the_shuffle(spark):
    plan = plan_of(QUERIES["dedupe_nonnull_counts"](spark, SF_DIR))
    assert "partial_min_by" in plan and "Window" not in plan


def test_a_detail_scans_its_facts_once(spark):
    """Total line and rows come from one exchange; also for an owner without rows and with a map column."""
    rows = QUERIES["detail_owner"](spark, SF_DIR)
    assert rows.count() > 1
    rows.collect()
    final = plan_of(rows).split("== Initial Plan ==")[0]
    assert "ReusedExchange" in final and final.count("lineitem.parquet") == 1
    facts = fact_frame(spark, {}, {"account": "beta-my", "spend": 2.5}).withColumn("extra", F.expr("map('a', clicks)"))
    lines = detail.detail(facts, "DIRECT", "202103", "ann").collect()
    assert [(r["ad_type"], r["account"], r["spend"], r["extra"]) for r in lines] == [("TOTAL", None, 12.5, None), ("DIRECT", "alpha-th", 10.0, {"a": 8}), ("DIRECT", "beta-my", 2.5, {"a": 8})]
    nobody = detail.detail(facts, "DIRECT", "202103", "nobody").collect()
    assert [(r["ad_type"], r["spend"], r["owner"]) for r in nobody] == [("TOTAL", None, None)]
