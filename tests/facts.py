"""Small hand-made fact frames."""

from __future__ import annotations

from datetime import date

from adtally.schema import FACT, MONEY, MONEY_UNITS

DEFAULTS = {
    "ad_type": "DIRECT",
    "account": "alpha-th",
    "perf_month": date(2021, 3, 1),
    "owner": "ann",
    "spend": 10.0,
    "ad_revenue": 40.0,
    "store_revenue": 100.0,
    "store_profit": 20.0,
    "non_ad_profit": 5.0,
    "ad_profit": 4.0,
    "ad_orders": 3,
    "clicks": 8,
}


def fact_frame(spark, *rows: dict):
    """Fact rows that differ from the defaults as given; amounts are in currency."""
    data = []
    for row in rows:
        row = {**DEFAULTS, **row}
        for name in MONEY:
            row[name] = None if row[name] is None else round(row[name] * MONEY_UNITS)
        data.append(tuple(row[name] for name in FACT.fieldNames()))
    return spark.createDataFrame(data, FACT)


def rows_of(df) -> list[dict]:
    return [row.asDict() for row in df.collect()]
