"""Text forms of report rows, for tables and JSON."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import page, sort_columns, total_order

# Fixed value: numbers beyond it are shown without their fraction.
WHOLE_ABOVE = 100

_PLACE = "place_of_the_line"


def display_text(value: str) -> str:
    """Cell text of a number: whole part beyond the limit, plain otherwise, empty for NULL."""
    size = f"abs({value})"
    cut = f"concat(if({value} < 0, '-', ''), cast(cast(floor({size}) as decimal(38,0)) as string))"
    # Below a thousandth the default text turns to powers of ten.
    tiny = f"rtrim('0', cast(cast({value} as decimal(38,18)) as string))"
    plain = f"if({size} > 0 and {size} < 0.001D, {tiny}, cast({value} as string))"
    return f"coalesce(if({size} > {WHOLE_ABOVE}, {cut}, {plain}), '')"


def display_format(df: DataFrame, numeric_cols: Sequence[str]) -> DataFrame:
    """The frame as texts; only the named columns follow the number rule."""
    return df.selectExpr(
        *[
            f"{display_text(f'`{name}`')} as `{name}`"
            if name in numeric_cols
            else f"coalesce(cast(`{name}` as string), '') as `{name}`"
            for name in df.columns
        ]
    )


def page_json_records(
    df: DataFrame,
    order_by: Sequence[str],
    offset: int,
    limit: int,
    shown: Callable[[DataFrame], DataFrame] = lambda rows: rows,
) -> DataFrame:
    """One row: the number of rows of the whole frame, and the page as a JSON array of objects.

    The number is a separate count, so the frame's rows are not gathered for
    it.  The array has at most ``limit`` objects, and none past the end.
    ``shown`` turns the rows of the page into their display form.
    """
    total = df.agg(F.count(F.lit(1))).scalar()
    # No more rows than the page has; the place is text, so that it isn't shown as a number.
    along = Window.orderBy(*sort_columns(total_order(df, order_by)))
    place = F.lpad(F.row_number().over(along).cast("string"), 10, "0").alias(_PLACE)
    lines = shown(page(df, order_by, offset, limit).select("*", place))
    record = F.expr(f"to_json(struct(* except ({_PLACE})), map('ignoreNullFields', 'false'))")
    lines = lines.select(F.struct(_PLACE, record.alias("record")).alias("line"))
    texts = lines.agg(F.array_join(F.sort_array(F.collect_list("line"))["record"], ",").alias("texts"))
    return texts.select(total.alias("total"), F.concat(F.lit("["), F.col("texts"), F.lit("]")).alias("rows"))


def json_values(df: DataFrame) -> DataFrame:
    """Each row as a JSON array of its values."""
    cells = ", ".join(f"cast(`{name}` as variant)" for name in df.columns)
    return df.selectExpr(f"to_json(array({cells})) as record")
