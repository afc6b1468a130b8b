"""Staged tables, the shared folder, and names and sizes that joins rely on."""

import os

import pytest

from adtally.llm import staging


class Session:
    """Settings only."""

    def __init__(self, **settings):
        self.settings, self.conf = settings, self

    def get(self, name, default=None):
        return self.settings.get(name, default)


def test_a_cluster_must_name_the_shared_folder():
    named = {"spark.checkpoint.dir": "hdfs://x/y/", "spark.master": "yarn", "spark.sql.warehouse.dir": "/w"}
    assert staging.shared_folder(Session(**named)) == "hdfs://x/y"
    assert staging.shared_folder(Session(**{"spark.master": "local[8]", "spark.sql.warehouse.dir": "/w"})) == "/w/llm-staging"
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://host:7077", ""):
        with pytest.raises(ValueError):
            staging.shared_folder(Session(**{"spark.master": master, "spark.sql.warehouse.dir": "/w"}))


def test_staged_tables_are_read_and_discarded(spark):
    table = staging.staged(spark.range(5))
    path = table._staged_at.removeprefix("file:")
    assert table.count() == 5 and os.path.isdir(path)
    staging.discard(table)
    assert not os.path.isdir(path)
    staging.discard(table)
    staging.discard(spark.range(2))


def test_small_sides_are_sent(spark):
    table = staging.staged(spark.range(5))
    for rows, sent in ((5, True), (4, False)):
        plan = spark.range(9).join(staging.sent_if_small(table, rows), "id")._jdf.queryExecution().optimizedPlan().toString()
        assert ("broadcast" in plan.lower()) == sent


def test_names_that_are_free(spark):
    frame = spark.createDataFrame([(1, 2, 3)], "__id int, ID int, `___X` int")
    assert staging.free_names(frame, "id", "x") == ["____id", "____x"]
    assert staging.free_names(frame.drop("__id", "___X"), "id") == ["__id"]
