"""Records of large API replies whose records are nested, read by many tasks.

A reply is split at closing braces, wherever they stand, and a task sees a
block of it: it can't know whether the block begins inside a quoted text, how
deep it is, or in which array.  So blocks are looked at twice.

1. Each block tells how many quotes it has, and by how much it goes deeper if it
   begins outside or inside a quoted text.  Running sums over a file's blocks
   (one small row each) give the state in which each block begins.
2. Knowing its state, a block gives the texts of the records in it, pieces of
   records that cross its ends, and whether its end lies in the array of
   records.  The last block before that says so settles it for those in between.

A file that is small enough is one block, and needs the second look alone.

Texts that cross blocks are put together by file and place; all are parsed by
Spark.  Reads one JSON object per file; elements that are neither an object
nor null are passed over.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialised

#: Bytes of a block that are looked at together.
CHUNK = 1 << 20

_QUOTE, _BACKSLASH = 34, 92
_STEP = np.zeros(256, np.int64)
_STEP[[123, 91]], _STEP[[125, 93]] = 1, -1
_IS_STEP = _STEP != 0
_NULL = re.compile(rb"(?<![\w.+-])null(?![\w.+-])")
_COLON = re.compile(rb"\s*:\s*")

_SEEN = "file string, block long, quotes long, outside long, inside long"
WHOLE, OPEN, PART, END = range(4)
_FOUND = "file string, block long, kind int, known boolean, text string, is_open boolean"


def _pieces(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    """The texts between closing braces, with their file and block, in the order of the file within a block."""
    texts = spark.read.option("lineSep", "}").text(list(files))
    return texts.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bytes, tuple]]:
    """File, block, bytes and further columns, in order; blocks come in chunks, each cut behind a closing brace."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values, files = batch.column(0), batch.column(1).dictionary_encode()
        blocks = batch.column(2).to_numpy()
        ends = np.cumsum(pc.binary_length(values).to_numpy().astype(np.int64) + 1)
        changes = (np.diff(files.indices.to_numpy()) != 0) | (np.diff(blocks) != 0) | (np.diff(ends // CHUNK) != 0)
        cuts = [0, *(np.flatnonzero(changes) + 1).tolist(), batch.num_rows]
        for low, high in zip(cuts, cuts[1:], strict=False):
            texts = pa.ListArray.from_arrays(pa.array([0, high - low], pa.int32()), values.slice(low, high - low))
            others = tuple(batch.column(i)[low].as_py() for i in range(3, batch.num_columns))
            yield files[low].as_py(), int(blocks[low]), pc.binary_join(texts, b"}")[0].as_py() + b"}", others


def unescaped_quotes(data: np.ndarray) -> np.ndarray:
    """Places of quotes that an even number of backslashes stands before."""
    quotes = np.flatnonzero(data == _QUOTE)
    if not len(quotes):
        return quotes
    behind = quotes[(quotes > 0) & (data[np.maximum(quotes - 1, 0)] == _BACKSLASH)]
    if not len(behind):
        return quotes
    other = np.flatnonzero(data != _BACKSLASH)
    before = np.searchsorted(other, behind) - 1  # the last sign before the backslashes
    run = behind - 1 - np.where(before >= 0, other[np.maximum(before, 0)], -1)
    return np.setdiff1d(quotes, behind[run % 2 == 1], assume_unique=True)


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each chunk: its quotes, and how much deeper it ends for both states it may begin in."""
    rows = []
    for file, block, text, _ in _chunks(batches):
        data = np.frombuffer(text, np.uint8)
        quotes, marks = unescaped_quotes(data), np.flatnonzero(_IS_STEP[data])
        odd = np.searchsorted(quotes, marks) & 1
        steps = _STEP[data[marks]]
        # A block may be seen in several chunks: which steps count in a later one depends on the quotes of those before.
        rows.append((file, block, len(quotes), int(steps[odd == 0].sum()), int(steps[odd == 1].sum())))
        if len(rows) >= 1000:
            yield _batch(rows, _SEEN)
            rows = []
    if rows:
        yield _batch(rows, _SEEN)


def _batch(rows: list[tuple], kind: str) -> pa.RecordBatch:
    types = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    fields = [x.split() for x in kind.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], types[t]) for i, (_, t) in enumerate(fields)], [n for n, _ in fields])


class _Reader:
    """Goes through the chunks of a block from a known state and gives ``(kind, known, text)``."""

    def __init__(self, field: str, quoted: bool, depth: int, first: bool):
        self.field, self.quoted, self.depth, self.over = field.encode(), quoted, depth, depth == 0 and not first
        self.known: bool | None = None  # whether the place is in the array of records; None if the block can't tell
        self.open: list[bytes] | None = [] if depth > 2 else None  # of a record that goes on
        self.begun = False  # whether that record began in this block
        self.begun_known: bool | None = None

    def _names_field(self, text: bytes, quotes: np.ndarray, place: int) -> bool:
        i = int(np.searchsorted(quotes, place))
        if i < 2:
            return False
        a, b = int(quotes[i - 2]), int(quotes[i - 1])
        return text[a + 1 : b] == self.field and _COLON.fullmatch(text, b + 1, place) is not None

    def chunk(self, text: bytes) -> Iterator[tuple[int, bool | None, bytes]]:
        if self.over:
            return
        data = np.frombuffer(text, np.uint8)
        quotes, marks = unescaped_quotes(data), np.flatnonzero(_IS_STEP[data])
        marks = marks[((np.searchsorted(quotes, marks) + self.quoted) & 1) == 0]
        steps = _STEP[data[marks]]
        depths = self.depth + np.cumsum(steps)
        self.quoted = bool((len(quotes) + self.quoted) & 1)
        low = np.flatnonzero(((steps > 0) & (depths <= 3)) | ((steps < 0) & (depths <= 2)))
        done = 0  # up to which place the text is used
        for place, step, depth in zip(marks[low].tolist(), steps[low].tolist(), depths[low].tolist(), strict=True):
            if step > 0 and depth == 3:
                if self.known is not False and text[place] == 123:
                    yield from self._nulls(text[done:place])
                self.open, self.begun, self.begun_known, done = [], True, self.known, place
            elif step < 0 and depth == 2:
                if self.open is not None:
                    record = b"".join([*self.open, text[done : place + 1]])
                    if not self.begun:
                        yield PART, None, record
                    elif self.begun_known is not False and record.startswith(b"{"):
                        yield WHOLE, self.begun_known, record
                self.open, self.begun, done = None, False, place + 1
            elif step > 0 and depth == 2:
                self.known = text[place] == 91 and self._names_field(text, quotes, place)
                done = place + 1
            elif depth == 1:
                if step < 0:
                    yield from self._nulls(text[done:place])
                    self.known = False
                done = place + 1
            elif depth == 0:
                self.over, self.known = True, False
                return
        self.depth = int(depths[-1]) if len(depths) else self.depth
        if self.open is not None:
            self.open.append(text[done:])
        elif self.depth == 2:
            yield from self._nulls(text[done:])

    def _nulls(self, text: bytes) -> Iterator[tuple[int, bool | None, bytes]]:
        if self.known is not False and b"null" in text:
            for _ in _NULL.finditer(text):
                yield WHOLE, self.known, b"null"

    def end(self) -> Iterator[tuple[int, bool | None, bytes, bool]]:
        is_open = self.open is not None and not self.over and self.begun and self.begun_known is not False
        if self.open is not None and not self.over:
            text = b"".join(self.open)
            if not self.begun:
                yield PART, None, text, False
            elif is_open:
                yield OPEN, self.begun_known, text, False
        yield END, self.known, b"", self.open is not None and self.begun


def _found(batches: Iterator[pa.RecordBatch], field: str) -> Iterator[pa.RecordBatch]:
    at, reader, rows, size = None, None, [], 0
    for file, block, text, state in _chunks(batches):
        if (file, block) != at:
            if reader:
                rows += [(*at, kind, known, part.decode("utf-8", "replace"), is_open) for kind, known, part, is_open in reader.end()]
            at, reader = (file, block), _Reader(field, bool(state[0]), state[1], block == 0)
        for kind, known, part in reader.chunk(text):
            rows.append((file, block, kind, known, part.decode("utf-8", "replace"), False))
            size += len(part)
        if size > CHUNK:
            yield _batch(rows, _FOUND)
            rows, size = [], 0
    if reader:
        rows += [(*at, kind, known, part.decode("utf-8", "replace"), is_open) for kind, known, part, is_open in reader.end()]
    if rows:
        yield _batch(rows, _FOUND)


def whole_record_texts(spark: SparkSession, files: Sequence[str], field: str = "data_list") -> DataFrame:
    """``text`` of each record, as ``record_texts`` gives it, of files small enough to be read as one text each: one pass over them."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                rows, size = [], 0
                for part in _whole(value.as_py(), field):
                    rows.append(part.decode("utf-8", "replace"))
                    size += len(part)
                    if size > CHUNK:
                        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], ["text"])
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], ["text"])

    texts = spark.read.text(list(files), wholetext=True, recursiveFileLookup=True)
    return texts.select(F.col("value").cast("binary").alias("value")).mapInArrow(found, "text string")


def _whole(text: bytes, field: str) -> Iterator[bytes]:
    """The records of a whole file.  It is one block, so that its state is known and nothing crosses its ends."""
    reader, start = _Reader(field, False, 0, True), 0
    if text and not text.endswith(b"}"):
        text += b"}"  # as the last text between closing braces gets one
    while start < len(text):
        end = text.find(b"}", start + CHUNK) + 1 or len(text)
        for _, known, part in reader.chunk(text[start:end]):
            if known:
                yield part
        start = end
    for kind, known, part, _ in reader.end():
        if kind == OPEN and known:
            yield part


def record_texts(spark: SparkSession, files: Sequence[str], field: str = "data_list") -> DataFrame:
    """``file, text``: the JSON text of each element of the array ``field`` of each file's object; text is ``null`` for a null.

    Files of equal records or repeated elements give as many rows.  A file
    without the array, or with an empty one, gives none.
    """
    pieces = _pieces(spark, files)
    chunks = materialised(pieces.mapInArrow(_seen, _SEEN).withColumn("nth", F.monotonically_increasing_id()))
    order = Window.partitionBy("file").orderBy("block", "nth")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # A few rows of numbers for each file.
    quoted = chunks.withColumn("quoted", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    deeper = quoted.withColumn("deeper", F.when(F.col("quoted") == 0, F.col("outside")).otherwise(F.col("inside")))
    depth = deeper.withColumn("depth", F.coalesce(F.sum("deeper").over(before), F.lit(0)))
    states = depth.groupBy("file", "block").agg(F.min_by("quoted", "nth").alias("quoted"), F.min_by("depth", "nth").alias("depth"))
    states = materialised(states)
    # Only a broadcast join leaves a block's texts in order: one row of two numbers for each block.
    known = pieces.join(F.broadcast(states), ["file", "block"]).select("value", "file", "block", "quoted", "depth")
    found = materialised(known.mapInArrow(lambda batches: _found(batches, field), _FOUND))
    ends = found.where(F.col("kind") == END).select("file", "block", "known", F.when(F.col("is_open"), F.col("block")).alias("opened"))
    back = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(
        "file", "block", F.coalesce(F.last("known", ignorenulls=True).over(back), F.lit(False)).alias("in_field"), F.last("opened", ignorenulls=True).over(back).alias("of_block")
    )
    placed = found.where(F.col("kind") != END).join(ends, ["file", "block"])
    ours = F.coalesce("known", "in_field")
    whole = placed.where((F.col("kind") == WHOLE) & ours).select("file", "text")
    parts = placed.where(F.col("kind") == PART).select("file", F.col("of_block").alias("start"), "block", "text")
    first = placed.where((F.col("kind") == OPEN) & ours).select("file", F.col("block").alias("start"), "block", "text")
    begun = first.select("file", "start")
    # The pieces of one record, which some reader has to hold whole anyway.
    joined = first.unionByName(parts.join(begun, ["file", "start"], "left_semi")).groupBy("file", "start")
    crossing = joined.agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("parts"))
    crossing = crossing.select("file", F.array_join(F.transform("parts", lambda x: x["text"]), "").alias("text"))
    return whole.unionByName(crossing.where(F.col("text").startswith("{")))
