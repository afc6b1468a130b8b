"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations only.

The rows form a tree, for example domain, language, source.  A budget of
tokens is handed down level by level.  Children share their parent's budget by
weight, but a child takes no more than it can hold: the tokens below it times
the number of epochs.  What a short child leaves goes to its siblings by
weight.  Since a parent can hold what its children can hold together, only
what all siblings leave goes to the parent's siblings, and so on to the root.

Each leaf then turns its budget into whole epochs of all its rows and a prefix
of one more: rows in the order of a hash seeded by the epoch, up to the last
that fits in full.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adtally.llm.staging import staged

#: About so many rows of a leaf are ordered by one task.
ROWS_PER_SLICE = 10_000
_TOP = 1 << 32


def estimated_tokens(text: Column) -> Column:
    """Four UTF-8 bytes a token, at least one for a text that isn't empty; null and empty texts have none."""
    return F.coalesce(F.floor((F.octet_length(text) + 3) / 4), F.lit(0)).cast("long")


def shared_out(nodes: DataFrame, parent: list[str], order: str) -> DataFrame:
    """``nodes`` with ``budget``: the parent's ``parent_budget`` shared by ``weight``, at most ``held`` each.

    Children are taken from the one that fills first.  Those whose share of
    what is left exceeds what they hold are filled; the others share the rest,
    with rounding by running totals so that nothing is lost.
    """
    filling = Window.partitionBy(*parent).orderBy(F.col("held") * F.lit(1.0) / F.col("weight"), F.col(order))
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    from_here = filling.rowsBetween(0, Window.unboundedFollowing)
    upto = filling.rowsBetween(Window.unboundedPreceding, 0)
    exact = "decimal(38,0)"
    out = nodes.withColumn("before", F.coalesce(F.sum("held").over(before), F.lit(0).cast("long")))
    out = out.withColumn("weights", F.sum("weight").over(from_here))
    full = F.col("held").cast(exact) * F.col("weights") <= (F.col("parent_budget") - F.col("before")).cast(exact) * F.col("weight")
    out = out.withColumn("is_full", full)
    siblings = Window.partitionBy(*parent)
    out = out.withColumn("rest", F.col("parent_budget") - F.coalesce(F.sum(F.when(F.col("is_full"), F.col("held"))).over(siblings), F.lit(0)))
    open_weight = F.when(~F.col("is_full"), F.col("weight")).otherwise(0)
    out = out.withColumn("open_all", F.sum(open_weight).over(siblings)).withColumn("open_upto", F.sum(open_weight).over(upto))
    # Quotients of whole numbers: div drops the remainder.
    share = "cast((cast(rest as decimal(38,0)) * {}) div open_all as bigint)"
    open_share = F.expr(share.format("open_upto") + " - " + share.format("(open_upto - weight)"))
    out = out.withColumn("budget", F.when(F.col("is_full"), F.col("held")).otherwise(F.least(open_share, F.col("held"))))
    return out.drop("before", "weights", "is_full", "rest", "open_all", "open_upto")


def budgets(leaves: DataFrame, path: list[str], weights: DataFrame | None, total_share: float, epochs: int) -> DataFrame:
    """``leaves`` (path columns, ``n``, ``tokens``) with ``budget``.

    ``weights`` has columns ``level`` (a path column's name), ``name`` and
    ``weight`` (a whole number over 0); a node that isn't listed has weight 1.
    The root's budget is ``total_share`` of all tokens, as far as the leaves
    hold it in ``epochs`` epochs.
    """
    spark = leaves.sparkSession
    if weights is None:
        weights = spark.createDataFrame([], "level string, name string, weight long")
    held = leaves.withColumn("held", F.col("tokens") * epochs)
    total = held.agg(F.least(F.sum("held"), F.floor(F.sum("tokens") * F.lit(total_share))).cast("long").alias("budget"))
    total = total.first()["budget"] or 0  # one number
    above, parent = None, []
    for depth, level in enumerate(path):
        keys = path[: depth + 1]
        own = held.groupBy(*keys).agg(F.sum("held").alias("held"))
        listed = weights.where(F.col("level") == level).select(F.col("name").alias("__name"), F.col("weight").cast("long").alias("weight"))
        own = own.join(listed, F.col(level).eqNullSafe(F.col("__name")), "left").drop("__name")
        own = own.withColumn("weight", F.coalesce("weight", F.lit(1)))
        if above is None:
            own = own.withColumn("parent_budget", F.lit(total).cast("long"))
        else:
            up = above.withColumnsRenamed({k: f"__{k}" for k in parent} | {"budget": "parent_budget"})
            same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in parent])
            own = own.join(up, same).drop(*[f"__{k}" for k in parent])
        above = shared_out(own, parent or [F.lit(0)], level).select(*keys, "budget")
        parent = keys
    named = above.withColumnsRenamed({k: f"__{k}" for k in path})
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in path])
    return leaves.join(named, same).select(*path, "n", "tokens", "budget")


def mixed(
    rows: DataFrame,
    path: list[str],
    weights: DataFrame | None = None,
    total_share: float = 1.0,
    epochs: int = 4,
    seed: int = 42,
    id_column: str = "id",
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """``copies`` of each row of a stored table with columns ``id_column``, ``tokens`` and the path.

    Returns the path, the id, tokens and copies (0 for rows that aren't
    drawn).  Null path values are nodes of their own.  Rows that repeat an id
    are drawn together or not at all: they are one row of their summed
    tokens in the order, and a null id is an id as well.  Rows of no tokens
    follow the prefix they fall in.  An empty table gives an empty result.

    The order of an epoch is the MD5 of seed, epoch and id.  A leaf is cut
    into slices of that order, as many as its rows ask for; totals of slices
    are summed first, so only rows of one slice meet in a task.
    """
    leaves = rows.groupBy(*path).agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"))
    leaf_budgets = staged(budgets(staged(leaves), path, weights, total_share, epochs))
    whole = F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(0)
    given = leaf_budgets.select(
        *[F.col(k).alias(f"__{k}") for k in path],
        whole.alias("whole"),
        (F.col("budget") - whole * F.col("tokens")).alias("part"),
        F.ceil(F.col("n") / F.lit(rows_per_slice)).alias("slices"),
    )
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in path])
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col("whole"), F.coalesce(F.col(id_column).cast("string"), F.lit("null"))).cast("binary"))
    drawn = rows.join(given, same).drop(*[f"__{k}" for k in path]).withColumn("key", key)
    place = F.expr(f"cast(conv(substring(key, 1, 8), 16, 10) as bigint) * slices div {_TOP}L")
    drawn = drawn.withColumn("slice", place)

    leaf = [*path, "slice"]
    slices = drawn.groupBy(*leaf).agg(F.sum("tokens").alias("slice_tokens"))
    upto = Window.partitionBy(*path).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("ahead", F.coalesce(F.sum("slice_tokens").over(upto), F.lit(0)))
    slices = slices.select(*[F.col(k).alias(f"__{k}") for k in leaf], "ahead")
    within = Window.partitionBy(*leaf).orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = drawn.withColumn("here", F.sum("tokens").over(within))
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in leaf])
    done = numbered.join(slices, same)
    extra = F.when((F.col("part") > 0) & (F.col("ahead") + F.col("here") <= F.col("part")), 1).otherwise(0)
    return done.select(*path, id_column, "tokens", (F.col("whole") + extra).cast("int").alias("copies"))
