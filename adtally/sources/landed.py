"""Landed upload folders: ``<root>/<shop>/<site>/<files>``.

A site's ad report is a CSV with a header whose name holds ``--``; its store
dashboard is a CSV without header whose name holds ``Dashboard``.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.casts import cast_cells
from ..functions.money import in_currency
from ..functions.text import is_uploaded_site
from ..operators.distinct import last_per_key
from ..operators.reshape import envelope_rows
from ..schema import DASHBOARD_CELLS, DASHBOARD_ROW, REPORT_COUNTS, REPORT_MONEY
from . import replies

# Marks in the names of landed files.
DASHBOARD_MARK = "Dashboard"
REPORT_MARK = "--"
TEMP_MARK = "$"

#: Bytes of a reply that may be one row, and its first characters that are looked at for nested records.
WHOLE_BYTES, PEEKED = 8 << 20, 1 << 14

AD_REPORT = "ad_report"
DASHBOARD = "dashboard"

# A site's folder lies in its shop's folder, whose name is the site's without the last three characters.
# Folders are looked at from the file upwards, so that a root of that form is not taken for a site's.
_SITE = r"^.*/([^/]+)/(\1[^/]{3})/"


def file_kind(name: str) -> str:
    """Kind of a file by its name; NULL for files that are not read."""
    return f"""case when contains({name}, '{TEMP_MARK}') then null
        when contains({name}, '{DASHBOARD_MARK}') then '{DASHBOARD}'
        when contains({name}, '{REPORT_MARK}') then '{AD_REPORT}' end"""


def site_of(path: str) -> str:
    """Site in a path: the deepest folder that lies in its shop's folder, NULL where none does."""
    return f"nullif(regexp_extract({path}, r'{_SITE}', 2), '')"


# File paths come as URIs; a plus sign in them is not an encoded space.
_PATH = "url_decode(replace(_metadata.file_path, '+', '%2B'))"


def _described(df: DataFrame, kind: str | None = None) -> DataFrame:
    """Adds site, kind, path and time of the file; keeps files of upload sites, of one kind or of any."""
    rows = df.selectExpr("*", f"{_PATH} as file", "_metadata.file_modification_time as modified")
    rows = rows.selectExpr(
        "*", f"{site_of('file')} as account", f"{file_kind("substring_index(file, '/', -1)")} as kind"
    )
    return rows.where(is_uploaded_site("account")).where(f"kind = '{kind}'" if kind else "kind is not null")


def of_sites(rows: DataFrame, sites: DataFrame) -> DataFrame:
    """Rows of the sites in ``account``."""
    return rows.join(sites.select("account"), "account", "left_semi")


def route_files(spark: SparkSession, root: str, listing: DataFrame | None = None) -> DataFrame:
    """Files of an upload, or of the given listing, with their site, kind and time; their content is not read."""
    if listing is None:
        listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return _described(listing).select("account", "kind", "file", "modified")


def latest_file_per_site(files: DataFrame) -> DataFrame:
    """The newest file of each site and kind; the later name among equally new ones."""
    return last_per_key(files, ["account", "kind"], ["modified", "file"])


def read_ad_reports(spark: SparkSession, root: str) -> DataFrame:
    """Rows of the newest ad report of each site, cells taken by header name, bad cells counted.

    ``missing_headers`` is the number of needed columns that the file doesn't
    have; an empty cell under a header is not missing.
    """
    cells = (
        spark.read.option("header", True)
        .option("singleVariantColumn", "cells")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", f"*{REPORT_MARK}*")
        .csv(root)
    )
    texts = [f"{_cell(name)} as `{name}`" for name in (*REPORT_MONEY, *REPORT_COUNTS)]
    rows = _newest(spark, root, _described(cells, AD_REPORT))
    needed = ("Placement", *REPORT_MONEY, *REPORT_COUNTS)
    held = " + ".join(f"int(array_contains(headers, '{name}'))" for name in needed)
    rows = rows.withColumn("headers", F.expr("json_object_keys(cast(cells as string))"))
    rows = rows.selectExpr("account", f"{_cell('Placement')} as placement", f"{len(needed)} - ({held}) as missing_headers", *texts)
    return cast_cells(rows, REPORT_MONEY, REPORT_COUNTS, keep=("account", "placement", "missing_headers"))


def _cell(header: str) -> str:
    return f"""try_variant_get(cells, "$['{header}']", 'string')"""


def read_dashboards(spark: SparkSession, root: str) -> DataFrame:
    """The data row of the newest dashboard of each site, cells taken by position, bad cells counted.

    Rows are counted inside each file, so every file is read as one text.
    """
    sheets = spark.read.text(
        root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=f"*{DASHBOARD_MARK}*"
    )
    cells = ", ".join(f"text_{name} string" for name in DASHBOARD_CELLS)
    line = f"get(split(value, r'\\r?\\n'), {DASHBOARD_ROW})"
    rows = _newest(spark, root, _described(sheets, DASHBOARD))
    rows = rows.selectExpr("account", f"from_csv({line}, '{cells}') as cells").select("account", "cells.*")
    revenue, *counts = DASHBOARD_CELLS
    typed = cast_cells(
        rows, {f"text_{revenue}": revenue}, {f"text_{name}": name for name in counts}, keep=("account",)
    )
    return typed.withColumn(revenue, F.expr(in_currency(revenue)))


def _newest(spark: SparkSession, root: str, rows: DataFrame) -> DataFrame:
    newest = latest_file_per_site(route_files(spark, root)).select("file")
    return rows.join(newest, "file", "left_semi")


def read_records(spark: SparkSession, path: str | Sequence[str], record: T.StructType, field: str = "data_list") -> DataFrame:
    """Records of all landed API replies, one JSON object per file; many tasks share a large reply.

    A file of flat records is read as the texts between closing braces,
    which Spark splits at any place.  Where such a text is neither a record nor
    what stands before or after the records, its whole file is read by
    ``replies.record_texts``, by many tasks as well, and files that don't begin
    as an object as one text each, as ``read_envelopes`` does.

    A file of at most ``WHOLE_BYTES``, and of one split, that has such a text among its first
    characters is known to need it, and its records are taken from it as one text.
    """
    paths = [path] if isinstance(path, str) else list(path)
    start = rf"""(?s)^\s*(\{{[^{{]*"{field}"\s*:\s*\[\s*|,\s*)\{{([^{{]*)$"""
    rest = rf"""(?s)^\s*(\][^{{\[]*|\{{[^{{]*"{field}"\s*:\s*\[\s*\][^{{\[]*)?$"""
    is_object = r"(?s)^[\s\ufeff]*\{"
    files, apart = _peeked(spark, paths, start, rest, is_object)
    parts = []
    if whole := [name for name, is_one in apart.items() if is_one]:
        found = replies.whole_record_texts(spark, paths if len(whole) == len(files) else whole, field)
        parts.append(found.select(F.from_json("text", record).alias("record")).select("record.*"))
    others = [name for name, is_one in apart.items() if not is_one]
    unknown = [name for name in files if name not in apart]
    if unknown or not files:
        texts = spark.read.option("lineSep", "}").option("recursiveFileLookup", True).text(paths if len(unknown) == len(files) else unknown)
        pieces = texts.selectExpr("value", "_metadata.file_path as file", "_metadata.file_block_start as block")
        pieces = pieces.withColumn("inner", F.regexp_extract("value", start, 2)).withColumn("is_record", F.regexp_like("value", F.lit(start)))
        marked = T.StructType([*record.fields, T.StructField("_broken", T.StringType())])
        options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}
        parsed = F.when(F.col("is_record"), F.from_json(F.concat(F.lit("{"), "inner", F.lit("}")), marked, options))
        pieces = pieces.withColumn("record", parsed)
        odd = (F.col("is_record") & F.col("record._broken").isNotNull()) | (~F.col("is_record") & ~F.regexp_like("value", F.lit(rest)))
        # The first text of a file tells whether it begins as an object.
        begins = F.min_by(F.regexp_like("value", F.lit(is_object)), F.struct("block", "nth"))
        seen = pieces.withColumn("nth", F.monotonically_increasing_id()).groupBy("file").agg(F.bool_or(odd).alias("odd"), begins.alias("is_object"))
        seen = seen.collect()  # names of files
        broken = [r["file"] for r in seen if r["odd"]]
        fields = [F.col(f"record.`{name}`") for name in record.fieldNames()]
        if len(broken) < len(seen) or not seen:
            left = spark.createDataFrame([(name,) for name in broken], "odd_file string")
            parts.append(pieces.where("is_record").join(F.broadcast(left), F.col("file") == F.col("odd_file"), "left_anti").select(*fields))
        if nested := [r["file"] for r in seen if r["odd"] and r["is_object"]]:
            found = replies.record_texts(spark, nested, field)
            parts.append(found.select(F.from_json("text", record).alias("record")).select(*fields))
        others += [r["file"] for r in seen if r["odd"] and not r["is_object"]]
    if others:
        parts.append(envelope_rows(read_envelopes(spark, others, record, field), field))
    return reduce(DataFrame.unionByName, parts)


def _peeked(spark: SparkSession, paths: list[str], start: str, rest: str, is_object: str) -> tuple[list[str], dict[str, bool]]:
    """All files, and those of the small ones whose first characters hold a text that is neither a record nor around records, with whether they begin as an object."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    sizes = {r["file"]: r["size"] for r in listing.selectExpr("_metadata.file_path as file", "_metadata.file_size as size").collect()}
    split = re.fullmatch(r"(\d+)b?", spark.conf.get("spark.sql.files.maxPartitionBytes"))
    small = [name for name, size in sizes.items() if size <= min(WHOLE_BYTES, int(split[1]) if split else WHOLE_BYTES)]
    if not small:
        return list(sizes), {}
    texts = spark.read.text(paths if len(small) == len(sizes) else small, wholetext=True, recursiveFileLookup=True)
    begin = F.split(F.left("value", F.lit(PEEKED)), r"\}")
    begin = texts.select(F.col("_metadata.file_path").alias("file"), F.slice(begin, 1, F.size(begin) - 1).alias("begin"))  # the last may go on
    odd = F.exists("begin", lambda x: ~F.regexp_like(x, F.lit(start)) & ~F.regexp_like(x, F.lit(rest)))
    found = begin.where(odd).select("file", F.regexp_like(F.col("begin")[0], F.lit(is_object)).alias("is_object")).collect()  # names of files
    return list(sizes), {r["file"]: r["is_object"] for r in found}


def read_envelopes(spark: SparkSession, path: str | Sequence[str], record: T.StructType, field: str = "data_list") -> DataFrame:
    """Landed API replies, one JSON object per file, with their records as an array."""
    envelope = T.StructType([T.StructField(field, T.ArrayType(record))])
    return spark.read.schema(envelope).option("multiLine", True).json(path)
