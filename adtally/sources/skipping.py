"""Which files of a fact table can hold a text: an index of character n-grams by file.

A value that contains a text contains all n-grams of the text.  So a file is
passed over if one of them is in none of its values.  The index is kept up to
date by ``partials.refresh`` with ``file_grams``; files that it doesn't know
yet are always read.  It helps where values are apart by file, as in facts
sorted by account.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import partials, versions
from .fact import read_fact

COLUMNS = ("account", "owner")
SIZES = (2, 3)


#: Distinct n-grams of ``value``; of a shorter value it is the value itself.
_GRAMS = "array_distinct(concat({}))".format(
    ", ".join(f"transform(sequence(1, greatest(length(value) - {size - 1}, 1)), i -> substring(value, i, {size}))" for size in SIZES)
)


def file_grams(facts: DataFrame, columns: Sequence[str] = COLUMNS) -> DataFrame:
    """Per file: its month, its name, and the n-grams of each column's values.  ``facts`` is read straight from files."""
    named = facts.select("perf_month", F.col("_metadata.file_path").alias("file"), *columns)
    values = named.unpivot(["perf_month", "file"], list(columns), "name", "value").distinct()
    grams = values.select("perf_month", "file", "name", F.explode_outer(F.expr(_GRAMS)).alias("gram"))
    sets = [F.collect_set(F.when(F.col("name") == name, F.col("gram"))).alias(f"{name}_grams") for name in columns]
    return grams.distinct().groupBy("perf_month", "file").agg(*sets)


def refresh(spark: SparkSession, facts_path: str, index_path: str, columns: Sequence[str] = COLUMNS) -> versions.Version:
    """Bring the index up to date; only months whose files have changed are read."""
    return partials.refresh(spark, facts_path, index_path, partial(file_grams, columns=columns))


def needed(text: str) -> list[str]:
    """The n-grams that a value with the text must have: the longest that the text allows, none for a single sign."""
    size = min(len(text), SIZES[-1])
    return sorted({text[i : i + size] for i in range(len(text) - size + 1)}) if size >= SIZES[0] else []


def texts_of(pattern: str) -> list[str]:
    """The plain texts that a value must contain to be LIKE the pattern."""
    parts = re.findall(r"((?:\\.|[^\\%_])+)", pattern, re.DOTALL)
    return [re.sub(r"\\(.)", r"\1", part, flags=re.DOTALL) for part in parts]


def files_with(spark: SparkSession, facts_path: str, index_path: str, contains: Mapping[str, Sequence[str]]) -> list[str]:
    """Files whose values may contain all texts asked of a column, and files that the index doesn't know."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(facts_path).select(F.col("path").alias("file"))
    index = partials.read(spark, index_path)
    tests = [F.array_contains(f"{name}_grams", gram) for name, texts in contains.items() for text in texts for gram in needed(text)]
    may = index.select(F.regexp_replace("file", "^file:/+", "file:/").alias("known"), reduce(Column.__and__, tests, F.lit(True)).alias("may"))
    found = files.join(may, F.regexp_replace("file", "^file:/+", "file:/") == F.col("known"), "left")
    return [r["file"] for r in found.where("may is null or may").select("file").collect()]  # names, not rows


def read(spark: SparkSession, facts_path: str, index_path: str, contains: Mapping[str, str] | None = None, like: Mapping[str, str] | None = None) -> DataFrame:
    """Fact rows whose columns contain the texts and are like the patterns, from no more files than needed."""
    asked: dict[str, list[str]] = {}
    tests = []
    for name, text in (contains or {}).items():
        asked.setdefault(name, []).append(text)
        tests.append(F.col(name).contains(text))
    for name, pattern in (like or {}).items():
        asked.setdefault(name, []).extend(texts_of(pattern))
        tests.append(F.col(name).like(pattern))
    whole = read_fact(spark, facts_path)
    files = files_with(spark, facts_path, index_path, asked)
    if not files:
        return whole.limit(0)
    rows = spark.read.schema(whole.schema).option("basePath", facts_path).parquet(*files)
    return rows.where(reduce(Column.__and__, tests, F.lit(True)))
