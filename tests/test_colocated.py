"""Bucketed tables, files passed over, and uploads that land in batches."""

import os

import pytest
from pyspark.sql import functions as F

from adtally.operators import keyed
from adtally.plans import ingest
from adtally.schema import REPORT_COUNTS, REPORT_MONEY
from adtally.session import released
from adtally.sources import bucketed, fact, partials, skipping, versions
from adtally.streaming import uploads
from checks import queries

from .facts import fact_frame

SF_DIR = "/root/testdata/sf0.001"


def sorted_rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_joins_of_bucketed_tables_need_no_exchange(spark):
    with released():
        sums, boards = queries.bucketed_inputs(spark, SF_DIR)
        size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            for plan in (ingest.site_kpis, ingest.rejects):
                rows = plan(sums, boards, keys=queries.SITE_KEYS)
                assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
        plain = queries.reports(spark, SF_DIR), queries.dashboards(spark, SF_DIR)
        assert sorted_rows(ingest.rejects(sums, boards, queries.SITE_KEYS)) == sorted_rows(ingest.rejects(*plain, queries.SITE_KEYS))
        for place in queries.PLACEMENTS:
            ours, theirs = (ingest.placement_kpis(*x, place, queries.LOAD_DATE, queries.SITE_KEYS) for x in ((sums, boards), plain))
            assert sorted_rows(ours) == sorted_rows(theirs)
        names = [t.name for t in spark.catalog.listTables() if t.name.startswith("adtally_")]
        assert names
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("adtally_")]


def test_summed_reports_keep_marks(spark):
    columns = {**{n: 1 for n in REPORT_MONEY.values()}, **{n: 2 for n in REPORT_COUNTS.values()}}
    rows = [("a", "p", 0, 0), ("a", "p", 1, 0), ("a", "q", 0, 2), ("b", None, 0, 0)]
    reports = spark.createDataFrame(rows, "account string, placement string, bad_cells int, missing_headers int")
    reports = reports.withColumns({n: F.lit(v).cast("bigint") for n, v in columns.items()})
    ours, theirs = ingest.report_sums(ingest.summed_reports(reports)), ingest.report_sums(reports)
    assert sorted_rows(ours.select(theirs.columns)) == sorted_rows(theirs)


@pytest.fixture
def indexed_facts(spark, tmp_path):
    rows = [{"account": f"{name}{i}-th", "owner": owner} for name, owner in (("alpha", "ann"), ("beta", "b%b"), ("gamma", None), ("délta", "a_b")) for i in range(20)]
    facts, index = str(tmp_path / "facts"), str(tmp_path / "index")
    for start in range(0, 80, 20):
        fact.write_fact(fact_frame(spark, *rows[start : start + 20]).coalesce(1), facts, "append")
    skipping.refresh(spark, facts, index)
    return facts, index


def test_files_without_the_text_are_passed_over(spark, indexed_facts):
    facts, index = indexed_facts
    whole = fact.read_fact(spark, facts)
    assert len(whole.inputFiles()) == 4
    for contains, like, files in (
        ({"account": "lph"}, None, 1), ({"account": "alpha1"}, None, 1), ({"account": "élt"}, None, 1), ({"account": "a"}, None, 4), ({"account": "-th"}, None, 4), ({"account": "zz"}, None, 0),
        ({"account": "ta"}, None, 2), (None, {"account": "%bet_%th"}, 1), (None, {"owner": "a\\_%"}, 1), (None, {"owner": "%"}, 4), ({"account": "ta"}, {"owner": "b%"}, 2), ({"account": "1-"}, {"owner": "ann"}, 1),
    ):
        rows = skipping.read(spark, facts, index, contains, like)
        test = F.lit(True)
        for name, text in (contains or {}).items():
            test = test & F.col(name).contains(text)
        for name, pattern in (like or {}).items():
            test = test & F.col(name).like(pattern)
        assert sorted_rows(rows.select(whole.columns)) == sorted_rows(whole.where(test)), (contains, like)
        assert len(rows.inputFiles()) == files, (contains, like)


def test_files_that_the_index_does_not_know_are_read(spark, indexed_facts):
    facts, index = indexed_facts
    fact.write_fact(fact_frame(spark, {"account": "omega"}), facts, "append")
    assert [r["account"] for r in skipping.read(spark, facts, index, {"account": "meg"}).collect()] == ["omega"]
    assert len(skipping.read(spark, facts, index, {"account": "lph"}).inputFiles()) == 2
    skipping.refresh(spark, facts, index)
    assert len(skipping.read(spark, facts, index, {"account": "lph"}).inputFiles()) == 1
    assert partials.read(spark, index).count() == 5


def test_texts_of_patterns():
    assert skipping.texts_of("%ab_c\\%d%") == ["ab", "c%d"] and skipping.texts_of("%_%") == [] and skipping.texts_of("a\\\\b") == ["a\\b"]
    assert skipping.needed("abcd") == ["abc", "bcd"] and skipping.needed("ab") == ["ab"] and skipping.needed("a") == []


HEADER = "Placement,Spend,Impression,Clicks,Store Orders,Store Units Sold,Store Revenue\n"


def land(root, site, spend=None, visitors=None):
    folder = root / site[:-3] / site
    folder.mkdir(parents=True, exist_ok=True)
    if spend is not None:
        (folder / f"{site}--{spend}.csv").write_text(HEADER + f"Sponsored Search,{spend},10,4,2,3,20.5\n")
    if visitors is not None:
        (folder / f"Dashboard {visitors}.csv").write_text("\n" * 6 + f"100.5,{visitors},7,5,50,6\n")


def kpi_rows(spark, table):
    return sorted((r["account"], r["Spend"], r["Product_Visitors"]) for r in keyed.read(spark, table).collect())


def test_uploads_are_ingested_as_they_land(spark, tmp_path, monkeypatch):
    root, table, progress = tmp_path / "up", str(tmp_path / "kpis"), str(tmp_path / "progress")
    land(root, "shop-th", 1.5, 30)
    land(root, "late-my", 2.5)

    def run():
        uploads.ingest_uploads(spark, str(root), table, progress).awaitTermination(120)

    run()
    assert kpi_rows(spark, table) == [("shop-th", 1.5, 30)]
    land(root, "late-my", None, 40)  # the dashboard lands behind its report
    land(root, "next-ph", 4.0, 50)
    plain = versions.commit

    def lost(*_):
        raise RuntimeError("lost before the commit")

    monkeypatch.setattr(versions, "commit", lost)  # between the rows' files and the manifest
    with pytest.raises(Exception, match="lost before the commit"):
        run()
    assert kpi_rows(spark, table) == [("shop-th", 1.5, 30)]

    def lost_after(*given):
        plain(*given)
        raise RuntimeError("lost behind the commit")

    monkeypatch.setattr(versions, "commit", lost_after)  # the batch is in, but the stream doesn't know
    with pytest.raises(Exception, match="lost behind the commit"):
        run()
    monkeypatch.setattr(versions, "commit", plain)
    number = versions.version(spark, table).number
    run()
    expected = [("late-my", 2.5, 40), ("next-ph", 4.0, 50), ("shop-th", 1.5, 30)]
    assert kpi_rows(spark, table) == expected and versions.version(spark, table).number == number
    land(root, "shop-th", 9.0)
    os.utime(root / "shop" / "shop-th" / "shop-th--9.0.csv", (2_000_000_000, 2_000_000_000))  # the newest report counts
    run()
    assert kpi_rows(spark, table) == [*expected[:2], ("shop-th", 9.0, 30)]
    run()
    assert versions.version(spark, table).number == number + 1
