"""The fact table as parquet partitioned by month, and its conversion from source names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions import money
from ..schema import COUNTS, FACT, MONEY, OPTIONAL_MONEY, SOURCE_AD_TYPES, SOURCE_COLUMNS


def from_source(df: DataFrame, account_column: str) -> DataFrame:
    """A table with the source system's names, types and codes as a fact frame."""
    return normalised(df.withColumnsRenamed({**SOURCE_COLUMNS, account_column: "account"}))


def normalised(df: DataFrame) -> DataFrame:
    """Currency amounts to fixed-point, months to their first day, ad types to codes; all other columns as they are.

    An amount that fixed-point can't hold ends the job with an error.
    """
    codes = " ".join(f"when '{name}' then '{code}'" for name, code in SOURCE_AD_TYPES.items())
    return df.selectExpr(
        f"case ad_type {codes} else ad_type end as ad_type",
        "account",
        "trunc(perf_month, 'month') as perf_month",
        "owner",
        *[f"{money.to_units(name)} as {name}" for name in _money(df)],
        *[f"cast({name} as bigint) as {name}" for name in COUNTS],
        *[f"`{name}`" for name in further(df)],
    )


def further(df: DataFrame) -> list[str]:
    """Columns that the data model doesn't name."""
    known = {*FACT.fieldNames(), *OPTIONAL_MONEY}
    return [name for name in df.columns if name not in known]


def in_currency(df: DataFrame) -> DataFrame:
    """Fact rows with money as double currency."""
    amounts = _money(df)
    return df.selectExpr(*[f"{money.in_currency(n)} as {n}" if n in amounts else f"`{n}`" for n in df.columns])


def _money(df: DataFrame) -> list[str]:
    return [name for name in MONEY + OPTIONAL_MONEY if name in df.columns]


def checked(df: DataFrame) -> DataFrame:
    """The frame itself once its columns are those of a fact table; an error otherwise."""
    for field in FACT.fields:
        if field.name not in df.columns:
            raise ValueError(f"fact column {field.name} is missing")
        if df.schema[field.name].dataType != field.dataType:
            raise ValueError(f"fact column {field.name} must be {field.dataType.simpleString()}")
    return df


def write_fact(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store a fact frame by month.

    The rebalance hint groups rows by month and lets adaptive execution split a
    month that is too large for one task, so a hot month is written by many.
    Overwriting replaces the months present in the frame and keeps the others.
    """
    (
        checked(df)
        .hint("rebalance", "perf_month")
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("perf_month")
        .parquet(path)
    )


def read_fact(spark: SparkSession, path: str) -> DataFrame:
    """Fact frame from its stored form: the declared columns, and all others that any stored file has.

    The files' schemas are merged, so that months written with more columns keep them.
    """
    stored = spark.read.option("mergeSchema", True).parquet(path)
    held = {field.name: field for field in stored.schema.fields}
    schema = T.StructType([*FACT.fields, *[held[name] for name in held if name not in FACT.fieldNames()]])
    return spark.read.schema(schema).parquet(path)


def append_rows(df: DataFrame, path: str) -> None:
    """Add a frame's rows to a stored table."""
    df.write.mode("append").parquet(path)
