"""Tables stored in buckets of their keys, whose joins and sums by those keys need no exchange.

Both sides of a join are dealt out once, when they are stored, and every later
ingest, check or correction meets them bucket by bucket.  A bucket is read by
one task, so tables with many rows of a key should be summed by it first, as
``ingest.report_sums`` does.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..session import scratch_table

#: Buckets of a table; tables that are to meet need the same number.
BUCKETS = 64


def stored(df: DataFrame, keys: Sequence[str], buckets: int = BUCKETS, table: str | None = None) -> DataFrame:
    """The frame as a table of the catalog in sorted buckets; without a name it goes with the intermediate tables."""
    table = table or scratch_table()
    dealt = df.repartition(buckets, *keys)
    dealt.write.bucketBy(buckets, *keys).sortBy(*keys).format("parquet").mode("errorifexists").saveAsTable(table)
    return df.sparkSession.table(table)
