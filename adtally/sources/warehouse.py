"""Ad facts derived from order-line, supplier and nation tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import in_month
from ..functions.money import rounded_units
from ..schema import AFFILIATE, DIRECT, FACT, MEASURES, RECOMMEND

# Declared, so that no footer has to be read before a plan is made.
TABLES = {
    "lineitem": """l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,
        l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string,
        l_shipdate timestamp_ntz""",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": """o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,
        o_orderdate timestamp_ntz, o_orderpriority string""",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}

_CENTS = {"p": rounded_units("l_extendedprice", 100), "d": rounded_units("l_discount", 100), "t": rounded_units("l_tax", 100)}
_FACTS = {
    "ad_type": f"case l_returnflag when 'R' then '{AFFILIATE}' when 'A' then '{DIRECT}' else '{RECOMMEND}' end",
    "perf_month": "cast(trunc(l_shipdate, 'month') as date)",
    "spend": "p * d",
    "ad_revenue": "p * (100 - d)",
    "store_revenue": "p * (100 + t)",
    "store_profit": "p * (2 * t - d)",
    "non_ad_profit": "p * t",
    "ad_profit": "p * (t - d)",
    "ad_orders": "cast(l_linenumber as bigint)",
    "clicks": "cast(l_quantity as bigint)",
}
_ACCOUNT = "concat(lower(s_name), case s_suppkey % 3 when 0 then '-th' when 1 then '-ph' else '-my' end) as account"


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}.parquet")


def ad_base(
    spark: SparkSession,
    root: str,
    columns: Iterable[str] | None = None,
    ym: str | None = None,
    further: Iterable[str] = (),
    summed: bool = False,
) -> DataFrame:
    """Fact frame with the asked columns, of one month or of all, and ``further`` columns of the order lines as they are.

    Every order line is one fact row.  Suppliers and nations only describe
    lines, so they are left-joined on their primary keys, and only where a
    described column is asked for.  No side is marked for broadcast: suppliers
    grow with the data, and adaptive execution chooses by measured size.  The
    month is tested on the ship date itself so that it reaches the scan.

    ``summed`` adds up the measures of each supplier and of the other asked
    columns before the suppliers are joined, for reports that only sum: then
    sums meet the suppliers instead of order lines.  A sum that a bigint can't
    hold ends the job with an error.
    """
    further = list(further)
    asked = [*(columns or FACT.fieldNames()), *further]
    described = [name for name in asked if name in ("account", "owner")]
    lines = table(spark, root, "lineitem")
    if ym is not None:
        lines = lines.where(in_month("l_shipdate", ym))
    facts = lines.selectExpr("*", *[f"{cents} as {name}" for name, cents in _CENTS.items()]).selectExpr(
        *[f"{_FACTS[name]} as {name}" for name in asked if name in _FACTS], *further, *(["l_suppkey"] if described else [])
    )
    if summed:
        keys = [name for name in facts.columns if name not in MEASURES]
        totals = [f"sum(`{name}`) as `{name}`" for name in facts.columns if name in MEASURES]
        facts = facts.groupBy(*keys).agg(*[F.expr(total) for total in totals])
    if described:
        sites = table(spark, root, "supplier").selectExpr("s_suppkey as l_suppkey", "s_nationkey", _ACCOUNT)
        facts = facts.join(sites, "l_suppkey", "left")
    if "owner" in described:
        # Joined last: Spark takes a join for as large as the product of its
        # sides, so suppliers joined to nations would look too large to send.
        owners = table(spark, root, "nation").selectExpr("n_nationkey as s_nationkey", "n_name as owner")
        facts = facts.join(owners, "s_nationkey", "left")
    return facts.select(*asked)
