"""Vectors in blocks: queries stream past groups of rows, one group in memory at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adtally.llm.staging import staged

#: Bytes of a group's doubles, which a task holds in memory, and rows of a block, which is one row of a table.
GROUP_BYTES, BLOCK_ROWS = 8 << 20, 1_024

BLOCK = "gid int, ids binary, vectors binary, extra binary, n int"


def usable(table: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``id, vector`` (doubles) of rows with an id and a vector without null or non-finite components.

    Vectors of another length than the most frequent one take no part.
    """
    rows = table.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("vector"))
    good = F.forall("vector", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    rows = rows.where(F.col("id").isNotNull() & (F.size("vector") > 0) & good)
    usual = rows.groupBy(F.size("vector").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    return rows.where(F.size("vector") == (usual["size"] if usual else 0))


def packed(rows: DataFrame, order: list[Column] | None, to: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], group_bytes: int = GROUP_BYTES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Stored blocks of ``rows`` (id, vector, and for ``extra`` a third column of doubles).

    ``gid`` numbers groups of about ``group_bytes`` of doubles, in ``order``
    if one is given; blocks of a group are in that order as well.  ``to`` turns the
    doubles of a block and its extra column into what is stored of them.
    """
    size = rows.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    many = max(1, -(-size[0] * 8 * (size[1] or 1) // group_bytes))
    if order:
        dealt = rows.repartitionByRange(many, *order).sortWithinPartitions(*order).withColumn("gid", F.spark_partition_id())
    else:
        dealt = rows.withColumn("gid", F.pmod(F.xxhash64("id"), F.lit(many)).cast("int")).repartition(many, "gid").sortWithinPartitions("gid")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gid = batch.column(batch.num_columns - 1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(gid)) + 1).tolist(), batch.num_rows]
            spans = [(i, min(block_rows, end - i)) for start, end in zip(cuts, cuts[1:], strict=False) for i in range(start, end, block_rows)]
            for part in (batch.slice(start, size) for start, size in spans):
                ids = part.column(0).to_numpy().astype(np.int64)
                flat = part.column(1).flatten().to_numpy().reshape(len(ids), -1)
                extra = part.column(2).to_numpy(zero_copy_only=False) if part.num_columns > 3 else np.empty(0)
                vectors, extra = to(flat, extra)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(part.num_columns - 1).slice(0, 1),
                        *[pa.array([x.tobytes()], pa.binary()) for x in (ids, np.ascontiguousarray(vectors), np.ascontiguousarray(extra))],
                        pa.array([len(ids)], pa.int32()),
                    ],
                    ["gid", "ids", "vectors", "extra", "n"],
                )

    return staged(dealt.mapInArrow(pack, BLOCK))


def searched(groups: DataFrame, queries: DataFrame, search: Callable[[list[tuple]], Callable[[tuple], tuple]], first: int = 0, last: int | None = None, score: str = "double", copies: int = 1) -> DataFrame:
    """``query_id, vec_id, score`` that ``search`` finds for each query in each group of ``first`` to ``last``.

    Each block of queries is sent to each group.  Sorted, a group's own blocks
    come first and stay in memory; blocks of queries follow one by one.
    ``search`` gets the group's blocks and returns what turns a block of
    queries into (query ids, ids, scores).  Each group is held by ``copies``
    tasks, which share the blocks of queries.
    """
    spark = groups.sparkSession
    top = groups.agg(F.max("gid")).first()[0]
    last = top if last is None else last
    kind = f"query_id long, vec_id long, score {score}"
    if top is None or last < first:
        return spark.createDataFrame([], kind)
    own = groups.where(F.col("gid").between(first, last)).withColumn("kind", F.lit(0)).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    sent = queries.withColumn("gid", F.explode(F.sequence(F.lit(first), F.lit(last)))).withColumn("kind", F.lit(1))
    sent = sent.withColumn("copy", F.pmod(F.xxhash64("ids"), F.lit(copies)).cast("int"))
    rows = own.unionByName(sent).repartition((last - first + 1) * copies, "gid", "copy").sortWithinPartitions("gid", "copy", "kind")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for gid, copy, ids, vectors, extra, n, kind in zip(*(batch.column(c) for c in ("gid", "copy", "ids", "vectors", "extra", "n", "kind")), strict=True):
                yield (gid.as_py(), copy.as_py()), kind.as_py(), (np.frombuffer(ids.as_buffer(), np.int64), vectors.as_buffer(), extra.as_buffer(), n.as_py())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, ready = None, [], None
        for gid, kind, block in blocks(batches):
            if gid != at:
                at, held, ready = gid, [], None
            if kind == 0:
                held.append(block)
            elif held:
                if ready is None:
                    ready = search(held)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in ready(block)], ["query_id", "vec_id", "score"])

    return rows.mapInArrow(run, kind)
