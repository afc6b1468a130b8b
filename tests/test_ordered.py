"""Positions, pages, neighbours and samples against plain Python lists."""

import os
import random

import pytest
from pyspark.sql import functions as F

from adtally.operators import distinct, ordered, totals
from adtally.session import released, shared_folder

HOT = 700


@pytest.fixture(scope="module")
def copies(spark):
    """A third and more of the rows are copies of one row; some values are missing."""
    rng = random.Random(5)
    rows = [("hot", 1)] * HOT + [(rng.choice("abcxyz"), rng.randrange(40)) for _ in range(1300)] + [(None, 3)] * 4
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "name string, n int").repartition(6)
    return frame, sorted(rows, key=lambda r: (r[1], r[0] is not None, r[0] or ""))


ORDER = ["n", "name"]


def test_positions_are_those_of_the_sorted_list(copies):
    frame, expected = copies
    placed = {r["idx"]: (r["name"], r["n"]) for r in ordered.indexed(frame, ORDER).collect()}
    assert [placed[i] for i in range(len(expected))] == expected


def test_equal_rows_are_split_over_ranges(spark, monkeypatch):
    """All rows are equal, yet no range holds more than its share."""
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        frame = spark.range(4000).selectExpr("1 as a", "'x' as b").repartition(5)
        ranged, place = ordered._ranged(frame, ["a"])
        sizes = [r["count"] for r in ranged.groupBy(F.shiftright(place, 33)).count().collect()]
        assert len(sizes) > 4 and max(sizes) < 1500
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_columns_of_any_name_are_kept(spark):
    frame = spark.createDataFrame([(2, "b", 1, 5), (1, "a", 1, 6)], "id int, __x string, place int, `t.i e` int")
    for rows in (ordered.indexed(frame, ["id"]), ordered.far_page(frame, ["id desc"], 0, 5), ordered.page(frame, ["t.i e"], 0, 5)):
        assert [c for c in rows.columns if c != "idx"] == frame.columns and rows.count() == 2
    assert ordered.sample_exact(frame, 1.0, ["id"], 1).columns == frame.columns


def test_positions_need_one_exchange_of_the_rows(copies):
    frame, _ = copies
    ranged, _ = ordered._ranged(frame, ORDER)
    plan = ranged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 1 and "hashpartitioning" not in plan


@pytest.mark.parametrize("part", [40, 100_000])
def test_pages_make_up_the_whole(copies, monkeypatch, part):
    monkeypatch.setattr(ordered, "PART_ROWS", part)
    frame, expected = copies
    for turn in (ordered.page, ordered.far_page):
        got = []
        for offset in range(0, len(expected) + 700, 700):
            got += [tuple(r) for r in turn(frame, ORDER, offset, 700).collect()]
        assert got == expected


@pytest.mark.parametrize("turn", [ordered.page, ordered.far_page])
def test_page_past_the_end_is_empty(copies, turn):
    frame, expected = copies
    assert turn(frame, ["n"], len(expected), 15).count() == 0
    assert turn(frame, ["n"], 1_000_000, 15).count() == 0
    assert turn(frame.limit(0), ["n"], 0, 15).count() == 0


def test_descending_far_page_with_nulls_last(spark, monkeypatch):
    monkeypatch.setattr(ordered, "PART_ROWS", 10)
    rows = [(None if i % 5 == 0 else i % 17, i) for i in range(300)]
    frame = spark.createDataFrame(rows, "a int, b int").repartition(4)
    expected = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    got = [tuple(r) for offset in range(0, 300, 60) for r in ordered.far_page(frame, ["a desc"], offset, 60).collect()]
    assert got == expected


def test_a_far_page_shuffles_no_rows(copies, monkeypatch):
    monkeypatch.setattr(ordered, "PART_ROWS", 40)
    frame, _ = copies
    plan = ordered.far_page(frame, ORDER, 900, 15)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan or "GlobalLimit" in plan
    assert plan.count("rangepartitioning") <= 1  # of the page's own rows


def turned(frame, order, limit):
    cursor, out = None, []
    while True:
        rows = ordered.page_after(frame, order, limit, cursor).collect()
        out += [tuple(r)[:-1] for r in rows]
        if len(rows) < limit:
            return out
        cursor = rows[-1]["cursor"]


def test_pages_behind_cursors_make_up_the_whole(spark):
    """Ascending and descending, null keys, and equal rows across a page's end."""
    rng = random.Random(4)
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice([None, "a", "b é", '"q"'])) for _ in range(170)]
    frame = spark.createDataFrame(rows, "n int, t string").repartition(3)
    for order in (["n"], ["n desc"], ["t desc", "n"]):
        whole = [tuple(r) for r in ordered.page(frame, order, 0, 500).collect()]
        assert turned(frame, order, 60) == whole
    assert ordered.page_after(frame.limit(0), ["n"], 5).count() == 0
    with pytest.raises(ValueError):
        ordered.page_after(frame, ["n"], 5, '{"seen": 1, "after": ["1"]}')


def test_cursors_of_any_type(spark):
    frame = spark.range(40).selectExpr(
        "if(id % 9 = 0, double('NaN'), id / 3D) as d", "cast(id % 3 as decimal(7, 3)) as m", "timestamp_micros(id % 4) as t", "cast(timestamp_micros(id * 7) as timestamp_ntz) as z",
        "unhex(hex(id % 5)) as b", "id % 2 = 0 as f", "date_add(date'2021-01-01', int(id % 6)) as day", "array(id % 3) as l", "cast(id % 7 / 3 as float) as s",
    ).repartition(3)
    for name in frame.columns:
        for order in ([name], [f"{name} desc"]) if name in ("d", "b") else ([f"{name} desc"],):
            whole = [str(tuple(r)) for r in ordered.page(frame, order, 0, 40).collect()]
            assert [str(x) for x in turned(frame, order, 21)] == whole


def test_a_page_behind_a_cursor_reads_no_earlier_month(spark, tmp_path):
    path = f"{tmp_path}/facts"
    spark.range(300).selectExpr("add_months(date'2021-01-01', int(id % 10)) as perf_month", "id as clicks").write.partitionBy("perf_month").parquet(path)
    facts = spark.read.parquet(path)
    last = ordered.page_after(ordered.far_page(facts, ["perf_month desc"], 95, 15), ["perf_month desc"], 15).collect()[-1]
    rows = ordered.page_after(facts, ["perf_month desc"], 15, last["cursor"])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "perf_month#" in plan.split("PartitionFilters: [")[1].split("]")[0] and "TakeOrderedAndProject" in plan
    assert [r["clicks"] for r in rows.collect()] == [6 + 10 * i for i in range(20, 30)] + [5 + 10 * i for i in range(5)]


@pytest.mark.parametrize("partitions", [1, 5])
def test_adjacent_duplicates(spark, partitions):
    rng = random.Random(9)
    keys = [rng.choice(["a]x", "a]y", "b", None, "c"]) for _ in range(500)]
    rows = [(place, key) for place, key in enumerate(keys)]
    frame = spark.createDataFrame(rows, "place int, title string").repartition(partitions)
    prefix = F.substring_index("title", "]", 1)
    got = ordered.adjacent_duplicates(frame, prefix, ["place"]).select("place").collect()
    cut = [key and key.split("]")[0] for key in keys]
    assert sorted(r["place"] for r in got) == [i for i in range(499) if cut[i] is not None and cut[i] == cut[i + 1]]


def test_nested_columns_are_ordered_by_their_text(spark, monkeypatch):
    frame = spark.range(160).selectExpr(
        "id % 3 as a", "named_struct('x', id % 7, 'y', if(id % 5 = 0, null, id)) as s", "array(id % 2, id) as l", "map('k', id) as m"
    ).repartition(4)
    whole = [r["l"][1] for r in ordered.page(frame, ["a desc"], 0, 160).collect()]
    for part in (30, 100_000):
        monkeypatch.setattr(ordered, "PART_ROWS", part)
        pages = [ordered.far_page(frame, ["a desc"], offset, 60) for offset in range(0, 160, 60)]
        assert pages[0].columns == frame.columns
        assert [r["l"][1] for rows in pages for r in rows.collect()] == whole
    placed = {r["idx"]: r["l"][1] for r in ordered.indexed(frame, ["a desc"]).collect()}
    assert [placed[i] for i in range(160)] == whole


def test_pages_of_any_type(spark, monkeypatch):
    """Dates, marks, decimals, doubles with NaN, texts, bytes and times, with nulls, both ways."""
    monkeypatch.setattr(ordered, "PART_ROWS", 15)
    texts = (
        "date_add(date'2021-01-01', int(id % 11))", "id % 2 = 0", "cast(id % 13 as short)", "cast(id % 17 / 4 as decimal(9, 2))", "if(id % 9 = 0, double('NaN'), id % 19 / 8D)",
        "concat('é', char(int(97 + id % 26)))", "encode(string(id % 21), 'utf-8')", "timestamp_micros(id % 23)", "cast(timestamp_micros(id % 23) as timestamp_ntz)",
    )
    for k, text in enumerate(texts):
        frame = spark.range(240).selectExpr(f"if(id % 10 = 3, null, {text}) as v", "id").repartition(3)
        for name in ("v", "v desc")[: 2 if k > 3 else 1] if k % 2 else ("v desc",):
            whole = [r["id"] for r in ordered.page(frame, [name], 0, 240).collect()]
            assert [r["id"] for r in ordered.far_page(frame, [name], 70, 120).collect()] == whole[70:190]


def test_a_far_page_reads_its_month_only(spark, tmp_path, monkeypatch):
    """Months are counted by one scan of one column; the page is read from its month's partition."""
    monkeypatch.setattr(ordered, "PART_ROWS", 500)
    path = f"{tmp_path}/facts"
    spark.range(3000).selectExpr("add_months(date'2021-01-01', int(id % 10)) as perf_month", "id as clicks").write.partitionBy("perf_month").parquet(path)
    facts = spark.read.parquet(path)
    rows = ordered.far_page(facts, ["perf_month desc"], 1010, 15)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert [r["clicks"] for r in rows.collect()] == [6 + 10 * i for i in range(110, 125)]
    assert plan.count("FileScan") == 1 and "PartitionFilters: [isnotnull(perf_month" in plan


def test_exact_sample_counts_further_where_digits_hold_many_rows(spark, monkeypatch):
    frame = spark.range(600).selectExpr("id", "if(id < 400, 0L, id) as key", "map('k', id) as m")
    whole = {r["id"] for r in ordered.sample_exact(frame.drop("m"), 0.4, ["key"], 3).collect()}
    assert len(whole) == 240
    monkeypatch.setattr(ordered, "PART_ROWS", 40)
    for digits in (4, 8):
        monkeypatch.setattr(ordered, "DIGITS", digits)
        assert {r["id"] for r in ordered.sample_exact(frame, 0.4, ["key"], 3).collect()} == whole
    assert ordered.sample_exact(frame, 0.0, ["key"], 3).count() == 0
    assert ordered.sample_exact(frame, 1.0, ["key"], 3).count() == 600
    assert ordered.sample_exact(frame.limit(0), 0.5, ["key"], 3).count() == 0


def test_adjacent_copies_of_a_row(spark):
    frame = spark.createDataFrame([(1, "a")] * 5 + [(2, "a"), (3, "b"), (4, None), (4, None)], "place int, title string")
    got = ordered.adjacent_duplicates(frame, F.col("title"), ["place"]).collect()
    assert sorted((r["place"], r["title"]) for r in got) == [(1, "a")] * 5


def test_exact_sample(spark):
    frame = spark.range(1000).withColumn("x", F.col("id") % 7)
    first = {r["id"] for r in ordered.sample_exact(frame, 0.33, ["id"], 7).collect()}
    again = {r["id"] for r in ordered.sample_exact(frame.repartition(3), 0.33, ["id"], 7).collect()}
    other = {r["id"] for r in ordered.sample_exact(frame, 0.33, ["id"], 8).collect()}
    assert len(first) == 330 and first == again and first != other


def test_exact_sample_of_repeated_keys(spark):
    """Rows that share a key, and equal rows, still give the exact size."""
    frame = spark.range(900).selectExpr("id % 3 as key", "if(id % 2 = 0, 0L, id) as v")
    assert ordered.sample_exact(frame, 0.25, ["key"], 7).count() == 225


def test_sample_does_not_depend_on_partitions(spark):
    frame = spark.range(1000).toDF("id")
    drawn = {r["id"] for r in ordered.sample(frame, 0.33, ["id"], 3).collect()}
    assert 250 < len(drawn) < 410
    assert drawn == {r["id"] for r in ordered.sample(frame.repartition(7), 0.33, ["id"], 3).collect()}


def test_intermediate_tables_are_removed(spark, copies, tmp_path):
    frame, _ = copies
    folder = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    with released():
        ordered.indexed(frame, ORDER).count()
        ordered.adjacent_duplicates(frame, F.col("name"), ORDER).count()
        assert set(os.listdir(folder)) - before
    assert not set(os.listdir(folder)) - before


def test_first_and_last_row_of_a_hot_key(spark):
    rows = [("hot", i, None if i == 0 else i) for i in range(900)] + [("cold", 5, 1), ("cold", 6, None)]
    frame = spark.createDataFrame(rows, "key string, place int, v int").repartition(7)
    first = {r["key"]: r["place"] for r in distinct.first_per_key(frame, ["key"], ["place"]).collect()}
    last = {r["key"]: r["place"] for r in distinct.last_per_key(frame, ["key"], ["place"]).collect()}
    assert first == {"hot": 0, "cold": 5} and last == {"hot": 899, "cold": 6}
    assert distinct.dedupe_counts(frame, "key", ["place"]).first().asDict() == {"key": 2, "place": 2, "v": 1}


def test_names_with_dots_and_spaces(spark):
    frame = spark.createDataFrame([("a", 1, 5), ("a", 2, 6)], "`k.e y` string, `o-r` int, `v 1` int")
    assert [tuple(r) for r in distinct.last_per_key(frame, ["k.e y"], ["o-r"]).collect()] == [("a", 2, 6)]
    assert totals.group_totals(frame, ["k.e y"], ["v 1"]).first()["v 1"] == 11
