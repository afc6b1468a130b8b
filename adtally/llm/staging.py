"""Tables written once in the cluster's shared folder, and the package on the executors."""

from __future__ import annotations

import atexit
import ctypes
import gc
import io
import os
import re
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch, and rows that a scan decodes at a time: thousands of long texts would be one large array.
_BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20, "spark.sql.parquet.columnarReaderBatchSize": 512}

_C = ctypes.CDLL(None)
_written: list[str] = []
_packages: list[str] = []
_shipped: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset, one below the warehouse of a local session, and an error for any other."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or f"{spark.conf.get('spark.sql.warehouse.dir')}/llm-staging").rstrip("/")


def staged(df: DataFrame) -> DataFrame:
    """The frame as a table in the shared folder: its plan never runs again, also when executors are lost.

    ``release`` removes the tables of this process; it is called when the process ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def discard(stored: DataFrame) -> None:
    """Removes a staged table that nothing will read any more."""
    path = getattr(stored, "_staged_at", None)
    if path in _written:
        _written.remove(path)
        _remove([path])


def release() -> None:
    """Removes all staged tables of this process.  Frames that still read them can't be used after it."""
    _remove(_written)


def _remove(paths: list[str]) -> None:
    spark = SparkSession.getActiveSession()
    while spark is not None and paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def _release_at_exit() -> None:
    try:
        _remove(_written)
        _remove(_packages)
    except Exception:  # noqa: BLE001  the session may be gone before the process is
        pass


#: Rows of a few numbers that a join may send to every executor; a larger side is dealt out by its key.
SENT_ROWS = 500_000


def sent_if_small(stored: DataFrame, rows: int = SENT_ROWS) -> DataFrame:
    """The stored table, to be sent to every executor if it has no more than ``rows`` rows."""
    return F.broadcast(stored) if stored.count() <= rows else stored


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Column names that the frame doesn't have, made of the given ones."""
    held = {c.lower() for c in df.columns}
    mark = "__"
    while any(f"{mark}{name}" in held for name in names):
        mark += "_"
    return [f"{mark}{name}" for name in names]


def trim() -> None:
    """Gives memory that Arrow and the C library hold free back to the system."""
    pa.default_memory_pool().release_unused()
    if hasattr(_C, "malloc_trim"):
        _C.malloc_trim(0)


def release_unused() -> None:
    """``trim`` behind Python's own collection; called where a task ends, as its worker lives on."""
    gc.collect()
    trim()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each Spark application, and bounds the session's batches.

    Texts differ by much in length, so that batches counted by rows alone would
    differ by much in memory, which a batch takes several times over on its way.

    The zip file lies in the shared folder until the process ends, as
    executors may join at any time.
    """
    for name, most in _BATCHES.items():
        if int(spark.conf.get(name).rstrip("b")) > most:
            spark.conf.set(name, str(most))
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as bundle:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    bundle.write(full, os.path.relpath(full, os.path.dirname(package)))
    place = f"{shared_folder(spark)}/llm-package-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{place}/adtally.zip")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out = files.create(path)
    out.write(held.getvalue())
    out.close()
    _packages.append(place)
    context.addPyFile(files.makeQualified(path).toString())
    _shipped.add(context.applicationId)
