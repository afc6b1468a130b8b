"""Whole-frame order at scale: positions, neighbours, pages and exact samples.

A window without partitions moves every row to one task.  Here rows are dealt
to ordered ranges by one range shuffle and sorted inside them, a range is one
task, and ranges are linked by one small row each.  A number behind the order
tells equal rows apart, so that ranges also split a row repeated a billion
times.  Spark chooses the number of ranges by their size.

The range of a row comes from where Spark put it, and two runs of a range
shuffle may cut differently.  So the ranged frame is written once to the
shared folder before anything refers to a range.

An order is a list of column names, ``name desc`` for descending.  All other
columns follow in it, so that only equal rows tie.  Arrays, structs, maps and
variants are ordered by their JSON text.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialised

# A part of the frame with no more rows is ordered by a bounded top-k.
PART_ROWS = 50_000
# Values sampled to cut a part, and cuts made of them: few, as each row is compared with all of them.
SAMPLED, CUTS = 1024, 15
# A column with no more values in its sample, and in all, is counted by value.
SAMPLED_VALUES, COUNTED_VALUES = 128, 20_000
# Hexadecimal digits of a digest by which an exact sample counts rows at a time.
DIGITS = 4
# Bits of monotonically_increasing_id that count rows inside a partition.
_INSIDE_BITS = 33


def _free(df: DataFrame, name: str) -> str:
    """A column name that the frame doesn't have."""
    while name in df.columns:
        name += "_"
    return name


def total_order(df: DataFrame, order_by: Sequence[str]) -> list[tuple[str, bool]]:
    """Names and whether descending: the asked order, and every other column behind it."""
    asked = [(text.removesuffix(" desc"), text.endswith(" desc")) for text in order_by]
    names = {name for name, _ in asked}
    return asked + [(name, False) for name in df.columns if name not in names]


def sort_columns(order: Sequence[tuple[str, bool]]) -> list[Column]:
    return [F.col(f"`{name}`").desc() if desc else F.col(f"`{name}`").asc() for name, desc in order]


def _is_nested(kind: T.DataType) -> bool:
    return isinstance(kind, T.ArrayType | T.StructType | T.MapType | T.VariantType)


def _keyed(df: DataFrame, order_by: Sequence[str]) -> tuple[DataFrame, list[tuple[str, bool]]]:
    """The frame with a text column for each nested one, and the total order, which names those texts."""
    order, texts = [], {}
    for name, desc in total_order(df, order_by):
        if _is_nested(df.schema[name].dataType):
            text = _free(df, f"{name}_text".replace(".", "_"))
            texts[text] = F.to_json(F.col(f"`{name}`"), {"ignoreNullFields": "false"})
            name = text
        order.append((name, desc))
    return df.withColumns(texts) if texts else df, order


def _ranged(df: DataFrame, order_by: Sequence[str]) -> tuple[DataFrame, str]:
    """Rows in ordered ranges, sorted inside, and the column that counts ranges (high bits) and rows inside (low bits)."""
    tie, place = _free(df, "tie"), _free(df, "place")
    keyed, order = _keyed(df, order_by)
    order = [*sort_columns(order), F.col(tie)]
    ranged = keyed.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*order)
    own = [F.col(f"`{name}`") for name in df.columns]
    return ranged.sortWithinPartitions(*order).select(*own, F.monotonically_increasing_id().alias(place)), place


def indexed(df: DataFrame, order_by: Sequence[str], name: str = "idx") -> DataFrame:
    """Rows with their position in the whole order, from 0."""
    ranged, place = _ranged(df, order_by)
    rows = materialised(ranged)
    part = F.shiftright(F.col(place), _INSIDE_BITS)
    # One row per range.
    sizes = rows.groupBy(part.alias("range")).agg(F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("range").alias("of_range"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    named = _free(df, "range")
    offsets = offsets.toDF(named, f"{named}_offset")
    placed = rows.join(F.broadcast(offsets), part == F.col(named))
    position = F.col(f"{named}_offset") + F.col(place).bitwiseAND(F.lit((1 << _INSIDE_BITS) - 1))
    return placed.select(position.alias(name), *[F.col(f"`{c}`") for c in df.columns])


def indexed_within(df: DataFrame, by: Sequence[str], order_by: Sequence[Column], name: str = "idx") -> DataFrame:
    """Position within small groups, such as the lines of a month's report."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order_by))
    return df.select((rank - 1).alias(name), *df.columns)


def page(df: DataFrame, order_by: Sequence[str], offset: int, limit: int) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of the ordered frame, by a top-k.

    Each task keeps ``offset + limit`` rows, so it is meant for the first
    pages; ``far_page`` holds no rows before the page.
    """
    keyed, order = _keyed(df, order_by)
    return keyed.orderBy(*sort_columns(order)).offset(offset).limit(limit).select(*[F.col(f"`{name}`") for name in df.columns])


def _before(name: str, desc: bool, value: object) -> Column:
    """Whether a row's value comes before the given one: NULL first in ascending columns and last in descending ones."""
    column = F.col(f"`{name}`")
    if value is None:
        return column.isNotNull() if desc else F.lit(False)
    if desc:
        return column > F.lit(value)
    return (column < F.lit(value)) | column.isNull()


def _after(name: str, desc: bool, value: object) -> Column:
    return _before(name, not desc, value)


def _same(name: str, value: object) -> Column:
    column = F.col(f"`{name}`")
    if value is None:
        return column.isNull()
    return F.isnan(column) if isinstance(value, float) and math.isnan(value) else column == F.lit(value)


def _few_values(kind: T.DataType) -> bool:
    """Types whose values are counted one by one: days, marks and small numbers."""
    return isinstance(kind, T.DateType | T.BooleanType | T.ByteType | T.ShortType)


def _sampled(df: DataFrame, name: str, desc: bool) -> list:
    """A bounded number of values of the column, in order."""
    draw = _free(df, "draw")
    some = df.select(F.col(f"`{name}`"), F.rand().alias(draw)).orderBy(draw).limit(SAMPLED).drop(draw)
    return [r[name] for r in some.orderBy(*sort_columns([(name, desc)])).collect()]


def _once(values: list) -> list:
    return [x for i, x in enumerate(values) if i == 0 or x != values[i - 1] and not (x != x and values[i - 1] != values[i - 1])]


def _pieces(df: DataFrame, name: str, desc: bool) -> list[tuple[Column, int, bool]]:
    """The frame in order of one column, in pieces: a test on the column, the piece's rows, and whether it is one value."""
    column, few = F.col(f"`{name}`"), _few_values(df.schema[name].dataType)
    values = [] if few else _sampled(df, name, desc)
    if few or len(_once(values)) <= SAMPLED_VALUES:
        counts = df.groupBy(column.alias("value")).agg(F.count(F.lit(1)).alias("rows")).orderBy(*sort_columns([("value", desc)]))
        found = (counts if few else counts.limit(COUNTED_VALUES + 1)).collect()
        if few or len(found) <= COUNTED_VALUES:
            return [(_same(name, r["value"]), r["rows"], True) for r in found]
    cuts = _once([values[len(values) * (i + 1) // (CUTS + 1)] for i in range(CUTS)])
    # Even numbers lie between cuts, odd ones are equal to a cut.
    steps = [F.when(_before(name, desc, cut), 0).when(_same(name, cut), 1).otherwise(2) for cut in cuts]
    number = reduce(Column.__add__, steps, F.lit(0))
    counts = {r["piece"]: r["rows"] for r in df.groupBy(number.alias("piece")).agg(F.count(F.lit(1)).alias("rows")).collect()}
    out = []
    for piece in sorted(counts):
        low, high = piece // 2 - 1, piece // 2
        if piece % 2:
            out.append((_same(name, cuts[high]), counts[piece], True))
            continue
        tests = ([_after(name, desc, cuts[low])] if low >= 0 else []) + ([_before(name, desc, cuts[high])] if high < len(cuts) else [])
        out.append((reduce(Column.__and__, tests), counts[piece], False))
    return out


def _parts(df: DataFrame, order: Sequence[tuple[str, bool]], begin: int, end: int, rows: int | None = None) -> Iterator[DataFrame]:
    """The ordered rows ``begin`` to ``end``, as frames one behind the other.

    The first column of the order is cut first: its values, or ranges of them,
    are counted, and those that hold the rows become a filter on that column
    alone, which reaches partitions and scans.  A value that is still too large
    is cut by the next column, a range by its own column again.
    """
    begin = max(0, begin)
    if begin >= end or rows is not None and begin >= rows:
        return
    if not order:  # equal rows: any of them will do
        yield df.limit(end - begin)
        return
    if rows is not None and rows <= PART_ROWS or begin == 0 and end <= PART_ROWS:
        yield df.orderBy(*sort_columns(order)).offset(begin).limit(end - begin)
        return
    if rows is not None and begin == 0 and end >= rows:
        yield df
        return
    (name, desc), done = order[0], 0
    for test, count, single in _pieces(df, name, desc):
        low, high = max(begin - done, 0), min(end - done, count)
        if low < high:
            yield from _parts(df.where(test), order[1:] if single else order, low, high, count)
        done += count


def _between(df: DataFrame, order_by: Sequence[str], begin: int, end: int) -> tuple[DataFrame, list[tuple[str, bool]]]:
    keyed, order = _keyed(df, order_by)
    parts = list(_parts(keyed, order, begin, end))
    return reduce(DataFrame.unionByName, parts) if parts else keyed.limit(0), order


def far_page(df: DataFrame, order_by: Sequence[str], offset: int, limit: int) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of the ordered frame, wherever the page lies.

    The page is found column by column: rows are counted by the values of the
    order's first column, then inside the value that holds the page by the next
    one, until few rows are left, which a top-k puts in order.  Each step reads one column
    and filters by plain comparisons, so that a month's partition is all that is read
    in the end.  No row is shuffled but the page's own.
    """
    rows, order = _between(df, order_by, offset, offset + limit)
    return rows.orderBy(*sort_columns(order)).select(*[F.col(f"`{name}`") for name in df.columns])


def _written(name: str, kind: T.DataType) -> Column:
    column = F.col(f"`{name}`")
    return F.base64(column) if isinstance(kind, T.BinaryType) else column.cast("string")


def _not_before(order: Sequence[tuple[str, bool]], values: Sequence[Column | None]) -> Column:
    """Whether a row stands at the given values or behind them; a bound of the first column alone comes first and reaches scans."""
    test = F.lit(True)
    for (name, desc), value in reversed(list(zip(order, values, strict=True))):
        column = F.col(f"`{name}`")
        if value is None:
            behind = F.lit(False) if desc else column.isNotNull()
            same = column.isNull()
        else:
            behind = (column < value) | column.isNull() if desc else column > value
            same = column == value
        test = F.coalesce(behind, F.lit(False)) | F.coalesce(same, F.lit(False)) & test
    (name, desc), value = order[0], values[0]
    if value is None:
        return F.col(f"`{name}`").isNull() & test if desc else test
    first = F.col(f"`{name}`") <= value if desc else F.col(f"`{name}`") >= value
    return (first | F.col(f"`{name}`").isNull() if desc else first) & test


def page_after(df: DataFrame, order_by: Sequence[str], limit: int, cursor: str | None = None, name: str = "cursor") -> DataFrame:
    """The ``limit`` rows behind the row of a cursor, or the first ones, each with its own cursor text as ``name``.

    A cursor holds the row's values in the order and how many rows equal to it
    have been shown up to it.  The next page is a range test, of which the first column's
    bound reaches partitions and scans, and a top-k of a page: nothing before the page is ordered or held, however
    far it lies.  Rows that come or go between two pages shift nothing.
    """
    keyed, order = _keyed(df, order_by)
    kinds = {column: keyed.schema[column].dataType for column, _ in order}
    texts = F.array(*[_written(column, kinds[column]) for column, _ in order])
    seen, after = 0, None
    if cursor is not None:
        held = json.loads(cursor)
        seen, after = held["seen"], held["after"]
        if len(after) != len(order):
            raise ValueError("the cursor is of another order")
        values = [
            None if text is None else F.unbase64(F.lit(text)) if isinstance(kinds[column], T.BinaryType) else F.lit(text).cast(kinds[column])
            for text, (column, _) in zip(after, order, strict=True)
        ]
        keyed = keyed.where(_not_before(order, values))
    rows = keyed.orderBy(*sort_columns(order)).offset(seen).limit(limit)
    own, text = [F.col(f"`{c}`") for c in df.columns], _free(keyed, "texts")
    rows = rows.withColumn(text, texts)
    # A page's rows only.
    nth = F.row_number().over(Window.partitionBy(text).orderBy(F.lit(1)))
    if after is not None:
        again = F.array(*[F.lit(x).cast("string") for x in after])
        nth = nth + F.when(F.col(text).eqNullSafe(again), F.lit(seen)).otherwise(0)
    shown = rows.select("*", F.to_json(F.struct(F.col(text).alias("after"), nth.alias("seen"))).alias(_free(keyed, name)))
    return shown.orderBy(*sort_columns(order)).select(*own, F.col(f"`{_free(keyed, name)}`").alias(name))


def sample_exact(df: DataFrame, fraction: float, key: Sequence[str], seed: int) -> DataFrame:
    """The whole number of rows nearest to the fraction, drawn by a seeded hash of the key.

    The rows with the least hashes are drawn.  Rows are counted by the first
    hexadecimal digits of the hash in one scan.  All rows below the digits that
    hold the last one are drawn, and of those digits as many as are missing; digits that hold too
    many rows for one task are counted further.  Rows that repeat a key share a hash; as many of them
    are drawn as are missing, in the order of their columns.  The same seed
    draws the same rows on any cluster.
    """
    digest = _free(df, "digest")
    texts = [F.col(f"`{name}`").cast("string") for name in key]
    drawn = df.withColumn(digest, F.md5(F.concat_ws(":", F.lit(str(seed)), *texts)))
    own = [F.col(f"`{name}`") for name in df.columns]
    found, part, left = [], drawn, None
    for digits in range(DIGITS, 32 + 1, DIGITS):
        head = F.substring(digest, 1, digits)
        counts = part.groupBy(head.alias("head")).agg(F.count(F.lit(1)).alias("rows")).orderBy("head").collect()  # 16 ** DIGITS at most
        if left is None:
            left = round(fraction * sum(r["rows"] for r in counts))
        upto = None
        for row in counts:
            if row["rows"] > left:
                upto = row
                break
            left -= row["rows"]
        if upto is None:
            found.append(part)
            break
        # Hexadecimal texts of one length are in order with their prefixes, so this is a plain comparison.
        found.append(part.where(F.col(digest) < upto["head"]))
        part = part.where(F.col(digest).startswith(upto["head"]))
        if not left:
            break
        if upto["rows"] <= PART_ROWS or digits == 32:
            found.append(_between(part, [digest, *key], 0, left)[0].select(*[F.col(f"`{name}`") for name in drawn.columns]))
            break
    return reduce(DataFrame.unionByName, found).select(*own)


def sample(df: DataFrame, fraction: float, key: Sequence[str], seed: int) -> DataFrame:
    """Each row with the given chance, by a seeded hash of its key: the same rows however the frame is partitioned.

    The size is near the fraction, not exact.
    """
    texts = [F.col(f"`{name}`").cast("string") for name in key]
    head = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *texts)), 1, 8)
    return df.where(F.conv(head, 16, 10).cast("bigint") < F.lit(int(fraction * 2**32)))


def adjacent_duplicates(df: DataFrame, key: Column, order_by: Sequence[str]) -> DataFrame:
    """Rows whose key equals the key of the row right after them; the key is added as ``key``."""
    keyed = df.withColumn("key", key.cast("string"))
    ranged, place = _ranged(keyed, order_by)
    kinds = _free(keyed, "kind")
    schema = ranged.withColumn(kinds, F.lit(0)).schema

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a range that the next one repeats (kind 0), its first row (1) and its last one (2)."""
        held: pa.RecordBatch | None = None  # the row before the batch
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is None:
                yield batch.slice(0, 1).append_column(kinds, pa.array([1], pa.int32()))
                rows = batch
            else:
                rows = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            keys = rows.column("key")
            again = pc.fill_null(pc.equal(keys.slice(0, rows.num_rows - 1), keys.slice(1)), False)
            hits = rows.slice(0, rows.num_rows - 1).filter(again)
            yield hits.append_column(kinds, pa.array([0] * hits.num_rows, pa.int32()))
            held = rows.slice(rows.num_rows - 1)
        if held is not None:
            yield held.append_column(kinds, pa.array([2], pa.int32()))

    found = materialised(ranged.mapInArrow(paired, schema))
    columns = [F.col(f"`{c}`") for c in keyed.columns]
    inside = found.where(F.col(kinds) == 0).select(*columns)
    # Two rows per range: its first and its last row, in the order of ranges.
    ends = found.where(F.col(kinds) > 0)
    along = Window.orderBy(F.shiftright(F.col(place), _INSIDE_BITS), kinds)
    after = _free(ends, "after")
    linked = ends.withColumn(after, F.lead("key").over(along))
    across = linked.where((F.col(kinds) == 2) & (F.col("key") == F.col(after))).select(*columns)
    return inside.unionByName(across)
