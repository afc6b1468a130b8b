"""Append the records of API replies to a table as the replies land."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.reshape import envelope_rows
from ..sources import versions
from ..sources.landed import read_records

_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def landed_records(spark: SparkSession, folder: str, record: T.StructType, field: str = "data_list") -> DataFrame:
    """Stream of the records of every reply that lands in the folder; a reply is one row of one task, so replies should be small."""
    envelope = T.StructType([T.StructField(field, T.ArrayType(record))])
    replies = spark.readStream.schema(envelope).option("multiLine", True).json(folder)
    return envelope_rows(replies, field)


def append_landed(records: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append what has landed since the last run, each reply exactly once, then stop.

    ``checkpoint`` belongs to this table and lies in shared storage.
    """
    return (
        records.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start(table)
    )


def reply_writer(table: str, record: T.StructType, source: str, field: str = "data_list") -> Callable[[DataFrame, int], None]:
    """What adds a batch of landed files to the versioned table; a batch is a piece of it and is never added twice."""

    def write(files: DataFrame, batch: int) -> None:
        spark = files.sparkSession
        known = versions.version(spark, table)
        done = known.about.get("batches", {})
        if done.get(source, -1) >= batch:
            return
        rows = read_records(spark, [r["path"] for r in files.select("path").collect()], record, field)  # names of files
        pieces = {**known.pieces, **versions.write_pieces(rows, table, F.lit(f"{len(known.pieces)}"))}
        versions.commit(spark, table, known, pieces, record, {**known.about, "batches": {**done, source: batch}})

    return write


def append_replies(spark: SparkSession, folder: str, record: T.StructType, table: str, checkpoint: str, field: str = "data_list") -> StreamingQuery:
    """Add the records of replies of any size that have landed since the last run, each reply exactly once, then stop.

    Large and nested replies are read by many tasks (``read_records``).  Read the table with ``versions.rows``.
    """
    files = spark.readStream.format("binaryFile").schema(_FILE).load(folder).select("path")
    stream = files.writeStream.foreachBatch(reply_writer(table, record, checkpoint, field))
    return stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
