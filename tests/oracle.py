"""Runs a registered query and its SQL and compares them as multisets of rows."""

from __future__ import annotations

from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck_rows(sql: str, root: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{root}/{name}.parquet'")
    result = con.execute(sql)
    names = [column[0] for column in result.description]
    return names, result.fetchall()


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    return df.columns, [tuple(row) for row in df.collect()]


def by_name(names: list[str], rows: list[tuple]) -> tuple[list[str], Counter]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(row[i] for i in order) for row in rows)


def differences(spark, run, sql: str, root: str) -> str | None:
    """None where both sides agree; otherwise what differs."""
    names, ours = by_name(*spark_rows(run(spark, root)))
    other_names, theirs = by_name(*duck_rows(sql, root))
    if names != other_names:
        return f"columns {names} and {other_names}"
    if ours == theirs:
        return None
    only_ours, only_theirs = list((ours - theirs).items())[:3], list((theirs - ours).items())[:3]
    return f"{sum(ours.values())} and {sum(theirs.values())} rows; {only_ours} / {only_theirs}"
