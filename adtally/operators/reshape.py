"""Long and wide forms, and rows out of JSON envelopes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.money import whole
from ..schema import OTHER_CATEGORY
from .totals import aggregated


def unpivot_totals(
    df: DataFrame,
    id_col: str,
    cols: Sequence[str],
    min_total: int,
    suffix: str = "",
    default: str = OTHER_CATEGORY,
) -> DataFrame:
    """Whole-unit totals per period and category of a wide table, above a floor.

    Each period is a column.  Cells are cut to whole units and summed per
    category while the table is still wide; only those sums are made long.
    Periods without a non-zero cell give no row.
    """
    periods = {name: name.removesuffix(suffix) for name in cols}
    if len(set(periods.values())) < len(periods):
        raise ValueError("two columns stand for the same period")
    wide = df.select(F.coalesce(id_col, F.lit(default)).alias("category"), *cols)
    sums = [f"sum(if(`{name}` <> 0, {whole(f'`{name}`')}, null)) as `{period}`" for name, period in periods.items()]
    long = aggregated(wide, ["category"], sums).unpivot("category", list(periods.values()), "period", "total")
    return long.where(F.col("total") > min_total).orderBy("category", "period", ascending=[False, True])


def parsed_envelopes(df: DataFrame, text: str, record: T.StructType, field: str = "data_list") -> DataFrame:
    """Adds the record array of envelope texts under the envelope's field name."""
    envelope = T.StructType([T.StructField(field, T.ArrayType(record))])
    return df.withColumn(field, F.from_json(text, envelope)[field])


def envelope_rows(raw: DataFrame, field: str = "data_list", keep: Sequence[str] = ()) -> DataFrame:
    """One row per record of the array held by each envelope.

    The plain generator would test the array in a filter of its own first, and
    parse an envelope text twice for it.
    """
    records = raw.selectExpr(*keep, f"posexplode_outer({field}) as (place, record)")
    return records.where("place is not null").select(*keep, "record.*")
