"""Upload folders on disk: routing, reading, KPI rows and rejected sites."""

import os

import pytest

from adtally.operators.upsert import save_upsert, upsert
from adtally.plans import ingest
from adtally.sources import landed

from .facts import rows_of

HEADER = "Placement,Spend,Impression,Clicks,Store Orders,Store Units Sold,Store Revenue"
# The same cells in another order, with a cell nobody reads.
OTHER_HEADER = "Store Revenue,Note,Clicks,Placement,Spend,Impression,Store Units Sold,Store Orders"


def dashboard(cells: str) -> str:
    return "\n".join(["Store dashboard", "", "period,March", "", "", "Revenue,Visitors,Buyers,Orders,Views,Units", cells, "tail"])


FILES = {
    "alpha/alpha-th/a--march.csv": f"{HEADER}\nSponsored Search,10.5,100,10,2,3,50\nSponsored Products,,50,5,1,1,20.25\n",
    "alpha/alpha-th/Dashboard march.csv": dashboard("1000.456,70,8,9,300,11,spare"),
    # Site in upper case, columns in another order, a quoted cell, a folder deeper.
    "beta/beta-PH/deep/b--march.csv": f'{OTHER_HEADER}\n30,"x, y",4,Sponsored Search,2,40,6,5\n',
    "beta/beta-PH/Dashboard+1.csv": dashboard("\"2000.5\",1,2,3,4,5"),
    # Text in a count, text in the dashboard, one of the two files only, short dashboard.
    "gamma/gamma-my/g--march.csv": f"{HEADER}\nSponsored Search,1,1,many,1,1,1\n",
    "gamma/gamma-my/Dashboard.csv": dashboard("5,1,1,1,1,1"),
    "delta/delta-th/d--march.csv": f"{HEADER}\nSponsored Search,1,1,1,1,1,1\n",
    "delta/delta-th/Dashboard.csv": dashboard("n/a,1,1,1,1,1"),
    "eps/eps-th/e--march.csv": f"{HEADER}\nSponsored Search,1,1,1,1,1,1\n",
    "zeta/zeta-th/Dashboard.csv": dashboard("5,1,1,1,1,1"),
    "eta/eta-th/h--march.csv": f"{HEADER}\nSponsored Search,1,1,1,1,1,1\n",
    "eta/eta-th/Dashboard.csv": "only\ntwo lines",
    # Not read: a lock file, a site elsewhere, a folder that is not in its shop, another name.
    "alpha/alpha-th/~$a--march.csv": "junk",
    "alpha/alpha-sg/a--march.csv": f"{HEADER}\nSponsored Search,1,1,1,1,1,1\n",
    "other/alpha-th/a--march.csv": f"{HEADER}\nSponsored Search,900,1,1,1,1,1\n",
    "alpha/alpha-th/notes.csv": "junk",
}
# An older report of a site that has a newer one.
OLD = "alpha/alpha-th/z--february.csv"


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    folder = tmp_path_factory.mktemp("upload here")
    for place, (name, text) in enumerate({**FILES, OLD: f"{HEADER}\nSponsored Search,77,1,1,1,1,1\n"}.items()):
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
        stamp = 1_600_000_000 + (0 if name == OLD else 1000 + place)
        os.utime(path, (stamp, stamp))
    return str(folder)


def test_files_are_routed_by_name_and_folder(spark, root):
    files = rows_of(landed.route_files(spark, root))
    found = {(f["account"], f["kind"], f["file"].split("upload here0/")[1]) for f in files}
    skipped = ("~$a", "alpha-sg", "other/", "notes")
    expected = [name for name in [*FILES, OLD] if not any(part in name for part in skipped)]
    assert {name for _, _, name in found} == set(expected)
    assert ("beta-PH", "ad_report", "beta/beta-PH/deep/b--march.csv") in found
    assert ("beta-PH", "dashboard", "beta/beta-PH/Dashboard+1.csv") in found


def test_newest_file_of_a_site_wins(spark, root):
    latest = rows_of(landed.latest_file_per_site(landed.route_files(spark, root)))
    alpha = [f["file"] for f in latest if f["account"] == "alpha-th" and f["kind"] == "ad_report"]
    assert len(alpha) == 1 and alpha[0].endswith("a--march.csv")
    assert len(latest) == len({(f["account"], f["kind"]) for f in latest})


def test_ad_reports_are_read_by_header_name(spark, root):
    rows = rows_of(landed.read_ad_reports(spark, root))
    by_site = {}
    for row in rows:
        by_site.setdefault(row.pop("account"), []).append(row)
    assert by_site["beta-PH"] == [
        {
            "placement": "Sponsored Search",
            "spend": 20_000,
            "store_revenue": 300_000,
            "impression": 40,
            "clicks": 4,
            "store_orders": 5,
            "store_units_sold": 6,
            "bad_cells": 0,
            "missing_headers": 0,
        }
    ]
    assert sorted(r["spend"] for r in by_site["alpha-th"]) == [0, 105_000]
    assert [r["bad_cells"] for r in by_site["gamma-my"]] == [1]


def test_dashboards_are_read_by_position(spark, root):
    boards = {row.pop("account"): row for row in rows_of(landed.read_dashboards(spark, root))}
    assert boards["alpha-th"] == {
        "account_revenue": 1000.456,
        "product_visitors": 70,
        "buyers": 8,
        "orders": 9,
        "pageviews": 300,
        "br_units_sold": 11,
        "bad_cells": 0,
    }
    assert boards["beta-PH"]["account_revenue"] == 2000.5
    assert boards["delta-th"]["bad_cells"] == 1 and boards["eta-th"]["bad_cells"] > 0


def test_every_site_is_a_kpi_row_or_a_reject(spark, root):
    reports, boards = landed.read_ad_reports(spark, root), landed.read_dashboards(spark, root)
    kpis = {row["account"]: row for row in rows_of(ingest.site_kpis(reports, boards, "date'2021-04-02'"))}
    rejected = {row["account"]: row["reason"] for row in rows_of(ingest.rejects(reports, boards))}
    assert rejected == {
        "gamma-my": "bad value in ad report",
        "delta-th": "bad value in dashboard",
        "eps-th": "no dashboard",
        "zeta-th": "no ad report",
        "eta-th": "bad value in dashboard",
    }
    assert set(kpis) == {"alpha-th", "beta-PH"}
    assert kpis["alpha-th"] == {
        "account": "alpha-th",
        "Revenue": 70.25,
        "Spend": 10.5,
        "Clicks": 15,
        "Units_Sold": 4,
        "Impressions": 150,
        "ad_orders": 3,
        "account_Revenue": 1000.46,
        "Product_Visitors": 70,
        "Buyers": 8,
        "Orders": 9,
        "br_Units_Sold": 11,
        "Pageviews": 300,
        "unit_cr": 0.27,
        "cpc": 0.7,
        "roi": 6.69,
        "update_time": "210402",
    }


def test_placements_apart(spark, root):
    reports, boards = landed.read_ad_reports(spark, root), landed.read_dashboards(spark, root)
    products = rows_of(ingest.placement_kpis(reports, boards, "Sponsored Products"))
    assert [(row["account"], row["Revenue"], row["Spend"], row["cpc"]) for row in products] == [
        ("alpha-th", 20.25, 0.0, 0.0)
    ]
    assert products[0]["roi"] is None
    search = {row["account"]: row["Clicks"] for row in rows_of(ingest.placement_kpis(reports, boards, "Sponsored Search"))}
    assert search == {"alpha-th": 10, "beta-PH": 4}


def test_an_upload_can_be_repeated(spark, root, tmp_path):
    reports, boards = landed.read_ad_reports(spark, root), landed.read_dashboards(spark, root)
    incoming = ingest.site_kpis(reports, boards, "date'2021-04-02'")
    kept = incoming.where("account = 'alpha-th'").selectExpr(
        "'kept-th' as account", *[f"`{name}`" for name in incoming.columns[1:]]
    )
    old = kept.unionByName(incoming.withColumn("Spend", incoming["Spend"] + 1))
    old.write.parquet(f"{tmp_path}/v1")
    save_upsert(spark, f"{tmp_path}/v1", incoming, f"{tmp_path}/v2")
    save_upsert(spark, f"{tmp_path}/v2", incoming, f"{tmp_path}/v3")
    once, twice = (sorted(map(tuple, spark.read.parquet(f"{tmp_path}/v{n}").collect())) for n in (2, 3))
    assert once == twice == sorted(map(tuple, kept.unionByName(incoming).collect()))
    with pytest.raises(ValueError):
        save_upsert(spark, f"{tmp_path}/v1", incoming, f"{tmp_path}/v1/")


def test_upsert_keeps_rows_without_key(spark):
    current = spark.createDataFrame([(None, 1), ("a", 1), ("b", 1)], "account string, v int")
    incoming = spark.createDataFrame([("a", 2), ("a", 3), (None, 4)], "account string, v int")
    rows = sorted(map(tuple, upsert(current, incoming).collect()), key=str)
    assert rows == sorted([(None, 1), ("b", 1), ("a", 2), ("a", 3), (None, 4)], key=str)


@pytest.mark.parametrize("gone", HEADER.split(","))
def test_a_report_without_a_needed_column_is_rejected(spark, tmp_path, gone):
    site = tmp_path / "up" / "alpha" / "alpha-th"
    site.mkdir(parents=True)
    names = [f"{name} x" if name == gone else name for name in HEADER.split(",")]
    (site / "a--march.csv").write_text(",".join(names) + "\nSponsored Search,10.5,100,10,2,3,50\n")
    (site / "Dashboard.csv").write_text(dashboard("5,1,1,1,1,1"))
    reports, boards = landed.read_ad_reports(spark, str(tmp_path / "up")), landed.read_dashboards(spark, str(tmp_path / "up"))
    assert rows_of(ingest.site_kpis(reports, boards)) == []
    assert [r["reason"] for r in rows_of(ingest.rejects(reports, boards))] == ["missing column in ad report"]


@pytest.mark.parametrize("root", ["up/up-01", "up/up-01/up-01-th/x", "alpha/alpha-th"])
def test_a_root_that_looks_like_a_site(spark, tmp_path, root):
    site = tmp_path / root / "beta" / "beta-my"
    site.mkdir(parents=True)
    (site / "a--march.csv").write_text(f"{HEADER}\nSponsored Search,10.5,100,10,2,3,50\n")
    (site / "Dashboard.csv").write_text(dashboard("5,1,1,1,1,1"))
    reports, boards = landed.read_ad_reports(spark, str(tmp_path / root)), landed.read_dashboards(spark, str(tmp_path / root))
    assert [r["account"] for r in rows_of(ingest.site_kpis(reports, boards))] == ["beta-my"]
