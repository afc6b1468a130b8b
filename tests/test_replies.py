"""Nested replies: records of many blocks against the whole-file reader and Python's own parser."""

import json
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adtally.operators import reshape
from adtally.schema import CAMPAIGN_RECORD
from adtally.sources import landed, replies, versions
from adtally.streaming import landing

NESTED = T.StructType(
    [
        T.StructField("account_name", T.StringType()),
        T.StructField("clicks", T.LongType()),
        T.StructField("stats", T.StructType([T.StructField("a", T.LongType()), T.StructField("list", T.ArrayType(T.StringType()))])),
    ]
)


def record(draw, i):
    text = "".join(draw.choice(['"', "\\", "}", "{", "[", "]", ",", "é", "\n", "null", "x", " "]) for _ in range(draw.randrange(12)))
    return {"account_name": f"{i} {text}", "clicks": i, "stats": {"a": i % 7, "list": [text, "}", draw.choice(["", "{"])]}, "more": {"deep": [{"x": [{}]}, [[]]]}}


ODD = {
    "before": '{"meta": {"data_list": [{"account_name": "no"}], "x": {"y": [{"z": 1}]}}, "data_list": [{"account_name": "a", "stats": {"a": 1}}]}',
    "after": '{"data_list": [{"account_name": "b", "stats": {"a": 2, "list": []}}], "more": [{"account_name": "no"}, {"stats": {}}], "total": {"n": 1}}',
    "nulls": '{"data_list": [null, {"stats": null}, null, {"stats": {"list": [null, "null"]}}]}',
    "spaces": ' \n{ "data_list"\n:\t[ {"account_name":"c" , "stats" : { "a" : 3 } } , {"stats":{}}\n ] } \n',
    "empty": '{"data_list": [], "x": {"y": {}}}',
    "none": '{"other": [{"account_name": "no", "stats": {"a": 1}}]}',
    "name": '{"x}data_list": [{"account_name": "no", "stats": {}}], "data_list ": [{"stats": {}}], "y": "data_list", "z": [{"stats": {}}], "data_list": [{"account_name": "d", "stats": {"a": 4}}]}',
    "escapes": json.dumps({"data_list": [{"account_name": '\\" } { \\\\', "stats": {"list": ["\\", '"', "\\\\\""]}}, {"account_name": "}", "stats": {}}]}),
    "unicode": json.dumps({"data_list": [{"account_name": "日本 🙂 é", "stats": {"a": 1}}]}, ensure_ascii=False),
}


def expected_texts(text):
    return [json.dumps(x, sort_keys=True) for x in json.loads(text).get("data_list", [])]


def found_texts(spark, files):
    out = {}
    for r in replies.record_texts(spark, files).collect():
        out.setdefault(r["file"].rsplit("/", 1)[1], []).append(json.dumps(json.loads(r["text"], strict=False), sort_keys=True))
    return {name: sorted(rows) for name, rows in out.items()}


@pytest.fixture
def in_small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "3000", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {name: spark.conf.get(name, None) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


@pytest.mark.parametrize("chunk", [40, 1 << 20])
def test_record_texts_of_odd_files(spark, tmp_path, monkeypatch, chunk):
    monkeypatch.setattr(replies, "CHUNK", chunk)
    for name, text in ODD.items():
        (tmp_path / f"{name}.json").write_text(text)
    found = found_texts(spark, [str(tmp_path)])
    assert found == {f"{name}.json": sorted(expected_texts(text)) for name, text in ODD.items() if expected_texts(text)}


@pytest.mark.parametrize("chunk", [40, 1 << 20])
def test_whole_files(spark, tmp_path, monkeypatch, chunk):
    """Small files are read as one text each, with the records that reading by blocks gives."""
    monkeypatch.setattr(replies, "CHUNK", chunk)
    draw = random.Random(5)
    rows = [record(draw, i) for i in range(50)]
    texts = {**ODD, "many": json.dumps({"meta": {"list": rows[:9]}, "data_list": [None, *rows], "tail": rows[:9]}, ensure_ascii=False), "cut": ODD["escapes"][:-30]}
    for name, text in texts.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / f"{name}.json").write_text(text)
        found = sorted(r["text"] for r in replies.whole_record_texts(spark, [f"{tmp_path}/{name}"]).collect())
        assert found == sorted(r["text"] for r in replies.record_texts(spark, [f"{tmp_path}/{name}"]).collect())
        assert name == "cut" or sorted(json.dumps(json.loads(x, strict=False), sort_keys=True) for x in found) == sorted(expected_texts(text))


def test_small_nested_replies_are_not_dealt_out(spark, tmp_path, monkeypatch):
    """A nested reply that fits a row is read once, and others beside it as before."""
    (tmp_path / "flat.json").write_text(json.dumps({"data_list": [{"account_name": "f", "clicks": 1}]}))
    (tmp_path / "several.json").write_text(f"[{ODD['before']}, {ODD['after']}]")
    (tmp_path / "nested.json").write_text(ODD["nulls"])
    plain = landed.read_records(spark, str(tmp_path), NESTED).collect()
    monkeypatch.setattr(replies, "record_texts", None)
    rows = landed.read_records(spark, str(tmp_path), NESTED).collect()
    assert len(rows) == 7 and sorted(map(str, rows)) == sorted(map(str, plain))
    assert landed.read_records(spark, f"{tmp_path}/nested.json", NESTED).count() == 4


def test_records_that_cross_blocks(spark, tmp_path, in_small_splits):
    """Blocks begin inside texts, at any depth; one record is larger than several blocks."""
    draw = random.Random(3)
    rows = [record(draw, i) for i in range(400)]
    rows[200]["stats"]["list"] = [f"}} long {i} {{" for i in range(1500)]
    text = json.dumps({"meta": {"list": [record(draw, 0) for _ in range(60)]}, "data_list": rows, "tail": [record(draw, 1) for _ in range(60)]}, ensure_ascii=False)
    (tmp_path / "large.json").write_text(text)
    (tmp_path / "small.json").write_text(ODD["before"])
    blocks = replies._pieces(spark, [str(tmp_path)]).select("file", "block").distinct().count()
    assert blocks > 30
    found = found_texts(spark, [str(tmp_path)])
    assert found["large.json"] == sorted(json.dumps(r, sort_keys=True) for r in rows) and len(found["small.json"]) == 1


def test_a_nested_reply_is_read_by_many_tasks(spark, tmp_path, in_small_splits):
    draw = random.Random(4)
    (tmp_path / "nested.json").write_text(json.dumps({"data_list": [record(draw, i) for i in range(3000)], "total": {"rows": 3000}}))
    (tmp_path / "flat.json").write_text(json.dumps({"data_list": [{"account_name": f"f{i}", "clicks": i} for i in range(300)]}))
    (tmp_path / "several.json").write_text(f"[{ODD['before']}, {ODD['after']}]")
    rows = landed.read_records(spark, str(tmp_path), NESTED)
    plain = reshape.envelope_rows(landed.read_envelopes(spark, str(tmp_path), NESTED))
    assert rows.columns == plain.columns and rows.count() == plain.count() == 3302
    assert rows.exceptAll(plain).count() == plain.exceptAll(rows).count() == 0
    pieces = replies._pieces(spark, [f"{tmp_path}/nested.json"])
    assert sum(r["count"] > 50 for r in pieces.groupBy(F.spark_partition_id()).count().collect()) > 3


def test_equal_files_of_flat_records(spark, tmp_path):
    for name in ("one", "two"):
        (tmp_path / f"{name}.json").write_text('{"data_list": [{"clicks": 1, "extra": {"x": 2}}]}')
    rows = landed.read_records(spark, [f"{tmp_path}/one.json", f"{tmp_path}/two.json"], CAMPAIGN_RECORD)
    assert [r["clicks"] for r in rows.collect()] == [1, 1]


def test_landed_replies_are_added_once(spark, tmp_path, monkeypatch):
    folder, table, progress = tmp_path / "landing", str(tmp_path / "table"), str(tmp_path / "progress")
    folder.mkdir()

    def run():
        landing.append_replies(spark, str(folder), NESTED, table, progress).awaitTermination(120)
        return sorted(r["account_name"] for r in versions.rows(spark, table).collect())

    (folder / "one.json").write_text(ODD["before"])
    (folder / "empty.json").write_text(ODD["empty"])
    assert run() == ["a"]
    (folder / "two.json").write_text(ODD["after"])
    plain = versions.commit

    def lost_after(*given):
        plain(*given)
        raise RuntimeError("lost behind the commit")

    monkeypatch.setattr(versions, "commit", lost_after)
    with pytest.raises(Exception, match="lost behind"):
        run()
    monkeypatch.setattr(versions, "commit", plain)
    assert run() == ["a", "b"] and run() == ["a", "b"]


def test_unescaped_quotes():
    draw = random.Random(1)
    for _ in range(300):
        text = "".join(draw.choice('"\\a') for _ in range(draw.randrange(14)))
        plain, run = [], 0
        for i, c in enumerate(text):
            if c == '"' and run % 2 == 0:
                plain.append(i)
            run = run + 1 if c == "\\" else 0
        data = pa.array([text]).cast(pa.binary())[0].as_py()
        assert replies.unescaped_quotes(np.frombuffer(data, np.uint8)).tolist() == plain
