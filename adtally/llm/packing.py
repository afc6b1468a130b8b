"""Best-fit packing of token sequences, planned on the histogram of lengths.

1. Texts are encoded once.  Only those longer than a sequence are cut, into
   full pieces and a last one.  A row for each piece is written.
2. The number of pieces of each length is all that is planned on: at most as
   many rows as a sequence has tokens, whatever the corpus.
3. Lengths are placed from long to short, each into the open sequences with
   the least room that holds it (best fit).  Sequences alike are handled as
   one range of sequence numbers, so the plan is bounded as well: a list of
   runs "pieces of length L with ranks from r on go to sequences from s on".
4. Each piece gets its rank within its length and takes the slot of its rank.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adtally.llm.ranks import ROWS_PER_SLICE, ranked
from adtally.llm.staging import ship, staged
from adtally.llm.tokens import encoded

CAPACITY = 4096
END_ID = 1

RUNS = "length long, first_rank long, ranks long, sequence long, each long, offset long"


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs ``(length, first_rank, ranks, sequence, each, offset)`` for so many pieces of each length.

    Rank ``first_rank + k`` goes to sequence ``sequence + k // each`` at
    ``offset + k % each * length``.
    """
    runs: list[tuple[int, int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens -> ranges (first sequence, sequences)
    sizes: list[int] = []  # keys of room, sorted
    opened = 0

    def keep(free: int, first: int, many: int) -> None:
        if not many or not free:
            return
        if free not in room:
            room[free] = []
            insort(sizes, free)
        room[free].append((first, many))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        if not 0 < length <= capacity:
            raise ValueError(f"a piece has {length} tokens")
        while left:
            at = bisect_left(sizes, length)
            if at < len(sizes):
                free = sizes[at]
                first, many = room[free].pop()
                if not room[free]:
                    del room[free], sizes[at]
            else:
                free, first = capacity, opened
                many = -(-left // (capacity // length))
                opened += many
            each = free // length
            full = min(many, left // each)
            if full:
                runs.append((length, rank, full * each, first, each, capacity - free))
                keep(free - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < many:
                if left:  # fewer than fill one sequence
                    runs.append((length, rank, left, first + full, left, capacity - free))
                    keep(free - left * length, first + full, 1)
                    rank, left, full = rank + left, 0, full + 1
                keep(free, first + full, many - full)
    return runs


def pieces(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    id_column: str = "doc_id",
    text_column: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """``id, piece, start, length, ids_crc32`` and on request ``ids`` of each piece of each text.

    A null or empty text is the end id alone.
    """
    ship(docs.sparkSession)
    columns = [F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids, bounds in encoded(batches, tokenizer):
            sizes = np.diff(bounds) + 1
            many = -(-sizes // capacity)
            doc = np.repeat(np.arange(len(sizes)), many)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
            start = piece * capacity
            length = np.minimum(capacity, sizes[doc] - start)
            own = [
                np.append(ids[bounds[d] + s : bounds[d] + s + n - last], np.full(last, end_id, "<u4")).astype("<u4")
                for d, s, n, last in zip(doc, start, length, (start + length == sizes[doc]).astype(int), strict=True)
            ]
            columns = [
                part.column(0).take(pa.array(doc)),
                pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()),
                pa.array(length, pa.int64()),
                pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64()),
            ]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array([x.view(np.int32) for x in own], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = "id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return docs.select(*columns).mapInArrow(cut, kind)


def packed(cut: DataFrame, capacity: int = CAPACITY, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Stored ``pieces`` with ``sequence_id`` and ``offset``.

    Rows that repeat an id, also whole rows, are pieces of their own.  An
    empty table gives an empty result.
    """
    spark = cut.sparkSession
    counts = {x["length"]: x["n"] for x in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    runs = spark.createDataFrame(plan(counts, capacity), RUNS)
    runs = runs.withColumnRenamed("length", "run_length")
    narrow = [c for c in cut.columns if c != "ids"]
    placed = ranked(cut.select(*narrow), "length", "rank", rows_per_slice)
    # The plan is bounded by the capacity, not by the corpus.
    own = (F.col("length") == F.col("run_length")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("ranks"))
    slot = F.col("rank") - F.col("first_rank")
    return placed.join(F.broadcast(runs), own).select(
        *narrow,
        (F.col("sequence") + F.floor(slot / F.col("each"))).alias("sequence_id"),
        (F.col("offset") + slot % F.col("each") * F.col("length")).alias("offset"),
    )


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    ``tokenizer`` is the path of a tokenizer file that each executor can read.
    """
    cut = staged(pieces(docs, tokenizer, capacity, end_id, id_column, text_column))
    return packed(cut, capacity).withColumnRenamed("id", id_column)


def sequences(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The packed sequences themselves: ``sequence_id``, ``ids`` and the pieces in them, in the order of their places."""
    cut = staged(pieces(docs, tokenizer, capacity, end_id, id_column, text_column, with_ids=True))
    keys = ["id", "piece", "start", "length", "ids_crc32"]
    rows = packed(cut, capacity).dropDuplicates([*keys, "sequence_id", "offset"])
    with_ids = cut.groupBy(*keys).agg(F.any_value("ids").alias("ids"))
    same = [rows[k].eqNullSafe(with_ids[k]) for k in keys]
    joined = rows.join(with_ids, same).select(*[rows[k] for k in keys], "sequence_id", "offset", "ids")
    parts = F.sort_array(F.collect_list(F.struct("offset", F.col("id").alias(id_column), "piece", "length", "ids")))
    grouped = joined.groupBy("sequence_id").agg(parts.alias("parts"))
    return grouped.select("sequence_id", F.flatten("parts.ids").alias("ids"), F.expr("transform(parts, p -> struct(p.offset, p." + id_column + ", p.piece, p.length))").alias("pieces"))
