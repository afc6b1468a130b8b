"""Uploads into the KPI table as they arrive, each exactly once.

A batch is the files that have landed since the last one.  The sites they
belong to are read again in whole, so that a report may land before or after
its dashboard, and their KPI rows replace the stored ones.  The table's
manifest notes the batch in the same step as its rows: a batch that is
repeated after a failure finds itself done, or nothing of itself.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import keyed
from ..plans import ingest
from ..sources import versions
from ..sources.landed import of_sites, read_ad_reports, read_dashboards, route_files

_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def landed_files(spark: SparkSession, root: str) -> DataFrame:
    """Stream of the upload's files with their site and kind; their content is not read."""
    listing = spark.readStream.format("binaryFile").schema(_FILE).option("recursiveFileLookup", True).load(root)
    return route_files(spark, root, listing)


def batch_writer(
    root: str, table: str, source: str, load_date: str = "current_date()", keys: Sequence[str] = ingest.DEFAULT_KEYS, buckets: int = 64
) -> Callable[[DataFrame, int], None]:
    """What brings a batch of landed files into the keyed table in ``table``; ``source`` names the stream in its notes."""

    def write(files: DataFrame, batch: int) -> None:
        spark = files.sparkSession
        sites = files.select("account").distinct()
        known = versions.version(spark, table)
        done = known.about.get("batches", {})
        if done.get(source, -1) >= batch:
            return
        kpis = ingest.site_kpis(of_sites(read_ad_reports(spark, root), sites), of_sites(read_dashboards(spark, root), sites), load_date, keys)
        if not known.number:
            keyed.create(kpis.limit(0), table, keys, buckets)
        keyed.upsert(spark, table, kpis, {"batches": {**done, source: batch}})

    return write


def ingest_uploads(
    spark: SparkSession, root: str, table: str, checkpoint: str, load_date: str = "current_date()", keys: Sequence[str] = ingest.DEFAULT_KEYS
) -> StreamingQuery:
    """Ingest what has landed below ``root`` since the last run, then stop.

    ``checkpoint`` belongs to this stream and table and lies in shared storage.
    """
    write = batch_writer(root, table, checkpoint, load_date, keys)
    files = landed_files(spark, root).writeStream.foreachBatch(write)
    return files.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
