"""Exact largest inner products of whole-number vectors, by descending length.

Vectors are kept in groups by descending length.  A group is rotated by the
right singular vectors of all rows, so that the first coordinates hold most of
each vector.  For a query with a bound (the k-th best score so far), vectors
whose length times the query's is below it can't win; of the others, partial
sums over the first coordinates plus the product of the residual lengths
(Cauchy-Schwarz) must reach it.  Only what passes is multiplied in full, in
whole numbers.

The longest group is searched first, for all queries, which copies of it share.  Its k-th scores are the
bounds with which all other groups are searched, in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adtally.llm import blocks
from adtally.llm.staging import ship, staged

#: Shares of the coordinates at which partial sums are tested.
STEPS = (0.25, 0.5)
#: Rows of a group that are looked at together, by descending length.
CHUNK = 2_048
#: Queries of a block; blocks of queries that a copy of the first group answers, and copies it has at least if there are as many blocks.
ASKED_ROWS, FIRST_BLOCKS, FIRST_COPIES = 256, 16, 64
#: Rounding of the rotated sums stays below this share of the lengths' product.
SLACK = 1e-9


def second_moments(rows: DataFrame) -> np.ndarray:
    """Sum of the outer products of all vectors; one matrix of the vectors' size reaches the driver."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
            for start in range(0, len(flat), 4096):
                part = flat[start : start + 4096]
                part = part / max(1.0, float(np.abs(part).max(initial=0.0)))
                total = part.T @ part + (0 if total is None else total)
        if total is not None:
            row, column = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(row.ravel()), pa.array(column.ravel()), pa.array(total.ravel())], ["i", "j", "s"])

    cells = rows.select("vector").mapInArrow(added, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    size = max((x["i"] for x in cells), default=-1) + 1
    out = np.zeros((size, size))
    for x in cells:
        out[x["i"], x["j"]] = x["s"]
    return out


def rotation(moments: np.ndarray) -> np.ndarray:
    """Right singular vectors as columns, the strongest first."""
    _, vectors = np.linalg.eigh(moments)
    return vectors[:, ::-1]


class Group:
    """The vectors of one group, longest first, with rotated coordinates and residual lengths."""

    def __init__(self, held: list[tuple], turn: np.ndarray, k: int):
        size = len(turn)
        self.k, self.turn = k, turn
        ids = np.concatenate([x[0] for x in held])
        whole = np.concatenate([np.frombuffer(x[1], np.int64).reshape(-1, size) for x in held])
        length = np.sqrt((whole.astype(np.float64) ** 2).sum(axis=1))
        order = np.lexsort((ids, -length))
        self.ids, self.whole, self.length = ids[order], whole[order], length[order]
        self.cuts = sorted({max(1, int(size * share)) for share in STEPS})
        turned = self.whole.astype(np.float64) @ turn
        self.turned = turned[:, : self.cuts[-1]].copy()
        self.rest = [np.sqrt((turned[:, cut:] ** 2).sum(axis=1)) for cut in self.cuts]
        self.most = float(np.abs(self.whole).max(initial=0))

    def products(self, queries: np.ndarray, own: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Exact inner products of pairs (query, row)."""
        out = np.empty(len(own), np.int64)
        for start in range(0, len(own), 1 << 16):
            part = slice(start, start + (1 << 16))
            out[part] = (queries[own[part]] * self.whole[at[part]]).sum(axis=1)
        return out

    def __call__(self, block: tuple) -> tuple:
        """The k best of the group for each query that reach its bound; ``extra`` holds bounds, NaN where there is none."""
        query_ids, queries, extra, _ = block
        queries = np.frombuffer(queries, np.int64).reshape(len(query_ids), -1)
        bound = np.frombuffer(extra, np.float64).copy() if len(extra) else np.full(len(query_ids), np.nan)
        bound = np.where(np.isnan(bound), -np.inf, bound)
        doubles = queries.astype(np.float64)
        length = np.sqrt((doubles**2).sum(axis=1))
        turned = doubles @ self.turn
        rest = [np.sqrt((turned[:, cut:] ** 2).sum(axis=1)) for cut in self.cuts]
        safe = self.most * float(np.abs(queries).max(initial=0)) * queries.shape[1] < 2.0**53
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(query_ids)
        for start in range(0, len(self.ids), CHUNK):
            rows = slice(start, start + CHUNK)
            alive = np.flatnonzero(length * self.length[start] * (1 + SLACK) >= bound)
            if not len(alive):
                break
            slack = SLACK * length[alive, None] * self.length[None, rows]
            sums, done = 0.0, 0
            own = at = None
            for cut, own_rest, row_rest in zip(self.cuts, rest, self.rest, strict=True):
                if own is None:
                    sums = sums + turned[alive, done:cut] @ self.turned[rows, done:cut].T
                    open_ = sums + own_rest[alive, None] * row_rest[None, rows] + slack >= bound[alive, None]
                    if open_.mean() < 0.1:
                        own, at = np.nonzero(open_)
                        sums = sums[own, at]
                else:
                    sums = sums + np.einsum("ij,ij->i", turned[alive[own], done:cut], self.turned[start + at, done:cut])
                    keep = sums + own_rest[alive[own]] * row_rest[start + at] + slack[own, at] >= bound[alive[own]]
                    own, at, sums = own[keep], at[keep], sums[keep]
                done = cut
            if own is None and safe:
                scores = doubles[alive] @ self.whole[rows].astype(np.float64).T
                own, at = np.nonzero(scores >= bound[alive, None])
                scores = scores[own, at].astype(np.int64)
            else:
                own, at = np.nonzero(open_) if own is None else (own, at)
                scores = self.products(queries, alive[own], start + at)
            ends = np.searchsorted(own, np.arange(len(alive) + 1))
            for i, q in enumerate(alive):
                part = slice(ends[i], ends[i + 1])
                found, score = self.ids[start + at[part]], scores[part]
                fresh = (found != query_ids[q]) & (score >= bound[q])
                if fresh.any():
                    found, score = np.concatenate([best[q][0], found[fresh]]), np.concatenate([best[q][1], score[fresh]])
                    order = np.lexsort((found, -score))[: self.k]
                    best[q] = found[order], score[order]
                    if len(order) == self.k:
                        bound[q] = max(bound[q], float(score[order[-1]]))
        counts = [len(x[0]) for x in best]
        return (
            np.repeat(query_ids, counts),
            np.concatenate([x[0] for x in best]) if best else np.empty(0, np.int64),
            np.concatenate([x[1] for x in best]).astype(np.int64) if best else np.empty(0, np.int64),
        )


def in_two_rounds(groups: DataFrame, asked: DataFrame, search, stored, k: int, score: str) -> DataFrame:
    """What ``search`` finds in the first group, and in all others with the first group's k-th score as a bound."""
    plain = blocks.packed(asked.withColumn("bound", F.lit(None).cast("double")), None, stored, block_rows=ASKED_ROWS)
    many = plain.count()
    copies = max(1, min(many, FIRST_COPIES), -(-many // FIRST_BLOCKS))
    first = staged(blocks.searched(groups, plain, search, 0, 0, score, copies))
    kth = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("bound"))
    kth = kth.select("query_id", F.when(F.col("n") >= k, F.col("bound").cast("double")).alias("bound"))
    bounded = asked.join(kth, asked["id"] == kth["query_id"], "left").select("id", "vector", "bound")
    return first.unionByName(blocks.searched(groups, blocks.packed(bounded, None, stored), search, 1, score=score))


def queries_of(rows: DataFrame, is_query: str, id_column: str) -> DataFrame:
    """One row of each id that meets the condition, which names the id by ``id_column`` and no other column."""
    named = rows.withColumnRenamed("id", id_column) if id_column != "id" else rows
    return named.where(F.expr(is_query)).dropDuplicates([id_column]).withColumnRenamed(id_column, "id")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query with rank, ties to the smaller id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def largest_products(
    table: DataFrame,
    is_query: str,
    k: int = 10,
    scale: float = 1024.0,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    group_bytes: int = blocks.GROUP_BYTES,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row that meets ``is_query``, the k rows of largest inner product.

    Components are floor(scale * x) as whole numbers; scores must fit in a
    long.  A query isn't its own candidate; rows with an id of their own but
    equal vectors are.  Of rows that repeat an id, each is a candidate for
    queries of other ids, and one is the query.  Rows without id, null
    vectors, those holding null or non-finite components and vectors of
    another length than most take no part.
    """
    ship(table.sparkSession)
    good = blocks.usable(table, id_column, vector_column)
    good = staged(good.select("id", F.transform("vector", lambda x: F.floor(x * scale).cast("double")).alias("vector")))
    turn = rotation(second_moments(good))
    if not len(turn):
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    length = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)

    def whole(vectors: np.ndarray, extra: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return vectors.astype(np.int64), extra

    groups = blocks.packed(good.withColumn("none", F.lit(0.0)), [F.desc(length), F.col("id")], whole, group_bytes)
    asked = queries_of(good, is_query, id_column)
    best = ranked(in_two_rounds(groups, asked, lambda held: Group(held, turn, k), whole, k, "long"), k)
    return best.select("query_id", "rank", "vec_id", F.col("score").cast("long").alias("score"))
