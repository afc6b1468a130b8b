"""Session defaults, and intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []
_TABLE = "table "


def build_session(app: str = "adtally", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on, skew handling included, and the web page off.

    Shuffles start with many partitions and are put together by their measured
    size, so that the number follows the data.  Dots in setting names are
    written as double underscores in ``conf``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.ui.enabled": "false",
        "spark.sql.session.timeZone": "UTC",
        # Call-site capture costs more than building the plan itself.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "2000",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        **{name.replace("__", "."): value for name, value in conf.items()},
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where that is unset it is one below the warehouse, for a session whose
    executors are the driver's own threads.  Any other session gets an error: only the
    cluster knows which folder its machines share.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not is_local(spark):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or f"{spark.conf.get('spark.sql.warehouse.dir')}/adtally-staging").rstrip("/")


def is_local(spark: SparkSession) -> bool:
    return re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")) is not None


def scratch_folder(spark: SparkSession) -> str:
    """A new name in the shared folder; what is written there goes with the intermediate tables."""
    path = f"{shared_folder(spark)}/adtally-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def scratch_table() -> str:
    """A new name for a table of the catalog; the table goes with the intermediate tables."""
    name = f"adtally_{uuid.uuid4().hex}"
    _written.append(f"{_TABLE}{name}")
    return name


def materialised(df: DataFrame) -> DataFrame:
    """The frame as a table written once in the shared folder.

    Later jobs read the columns they need from it and never run the plan
    behind it again, also when executors are lost.  ``release`` removes the
    tables; it runs when the process ends, and ``released`` removes those of a
    block of code.
    """
    path = scratch_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(since: int = 0) -> None:
    """Remove the intermediate tables written after the first ``since``; frames over them can't be used any more."""
    spark = SparkSession.getActiveSession()
    while spark is not None and len(_written) > since:
        name = _written.pop()
        if name.startswith(_TABLE):
            spark.sql(f"drop table if exists {name.removeprefix(_TABLE)}")
            continue
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def released() -> Iterator[None]:
    """Removes the intermediate tables of the block when it is left; use or write its frames inside."""
    since = len(_written)
    try:
        yield
    finally:
        release(since)


@atexit.register
def _release_at_exit() -> None:
    try:
        release()
    except Exception:  # noqa: BLE001  the session may be gone before the process is
        pass
