"""Approximate nearest neighbours by a permutation index.

1. Rows get one more coordinate that brings all to the length of the longest; queries get 0 there.
   The order by angle to a query is then the order by inner product, whatever the rows' lengths.
   Pivots are such rows, drawn by a hash of their id, a fixed number of them.
2. Every row is represented by its nearest pivots in order.
3. The index is cut into groups of rows.  A group has an inverted file: for
   each pivot, the rows that list it and its place in their lists.
   Equal vectors are posted once.
4. A query is sent to each group.  Posting lists of the query's own pivots add
   up to the footrule distance of the lists: a pivot that both list at places
   i and j brings 2 * (length - max(i, j)) off the distance of lists without a
   common pivot.
5. The rows of least footrule distance are multiplied with the query in double
   precision.  The first group's k-th product is a bound: other groups return
   what reaches it, and the best of all groups are the result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adtally.llm import blocks, topk
from adtally.llm.staging import ship, staged

PIVOTS, LISTED = 512, 64
#: Distinct vectors of a group that are reranked for a query: a share of the group's, and so many times k at least.
RERANKED, LEAST_TIMES = 0.25, 5

#: Matrix products differ from sums row by row by less than this share of the largest.
ROUNDING = 1e-9


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors**2).sum(axis=1, keepdims=True))


def lifted(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Directions of the rows with one more coordinate, by which all are as long as the longest."""
    share = vectors / longest
    return unit(np.c_[share, np.sqrt(np.maximum(0.0, 1.0 - (share**2).sum(axis=1)))])


def asking(queries: np.ndarray) -> np.ndarray:
    """Directions of queries beside lifted rows."""
    return np.c_[unit(queries), np.zeros(len(queries))]


def nearest_pivots(directions: np.ndarray, pivots: np.ndarray, listed: int) -> np.ndarray:
    """Numbers of the ``listed`` nearest pivots of each direction, the nearest first, ties to the smaller number."""
    near = directions @ pivots.T
    return np.argsort(-near, axis=1, kind="stable")[:, :listed].astype(np.int16)


class InvertedFile:
    """The distinct vectors of one group, posted under their pivots."""

    def __init__(self, held: list[tuple], pivots: np.ndarray, k: int, reranked: float, least: int):
        size = pivots.shape[1] - 1
        self.pivots, self.k = pivots, k
        ids = np.concatenate([x[0] for x in held])
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        vectors = np.concatenate([np.frombuffer(x[1], np.float64).reshape(-1, size) for x in held])[order]
        _, first, same = np.unique(vectors.view(f"V{8 * size}").ravel(), return_index=True, return_inverse=True)
        # Of equal vectors, only the k + 1 smallest ids can be among the k nearest of any query.
        self.rows = np.argsort(same, kind="stable")
        self.bounds = np.searchsorted(same[self.rows], np.arange(len(first) + 1))
        self.vectors = vectors[first]
        lists = np.concatenate([np.frombuffer(x[2], np.int16).reshape(len(x[0]), -1) for x in held])[order][first]
        self.listed = lists.shape[1]
        self.wanted = min(len(first), max(least, k + 1, int(np.ceil(reranked * len(first)))))
        posted = np.argsort(lists.ravel(), kind="stable")
        self.posted = (posted // self.listed).astype(np.int32)
        self.places = (posted % self.listed).astype(np.int32)
        self.starts = np.searchsorted(lists.ravel()[posted], np.arange(len(pivots) + 1))

    def footrule_saved(self, own: np.ndarray) -> np.ndarray:
        """Half of what the common pivots take off the footrule distance, for each vector."""
        saved = np.zeros(len(self.vectors), np.int32)
        for place, pivot in enumerate(own):
            part = slice(self.starts[pivot], self.starts[pivot + 1])
            saved[self.posted[part]] += self.listed - np.maximum(self.places[part], place)
        return saved

    def __call__(self, block: tuple) -> tuple:
        query_ids, queries, extra, _ = block
        queries = np.frombuffer(queries, np.float64).reshape(len(query_ids), -1)
        bounds = np.frombuffer(extra, np.float64)  # NaN where there is none
        lists = nearest_pivots(asking(queries), self.pivots, self.listed)
        found = []
        for query_id, query, own, bound in zip(query_ids, queries, lists, bounds, strict=True):
            saved = self.footrule_saved(own)
            if self.wanted < len(saved):
                near = np.argpartition(-saved, self.wanted - 1)[: self.wanted]
            else:
                near = np.arange(len(saved))
            rough = self.vectors[near] @ query
            # Each vector stands for one id at least, but for the query's own.
            if len(near) > self.k + 1:
                last = np.partition(rough, len(rough) - self.k - 1)[len(rough) - self.k - 1]
                near = near[rough >= last - ROUNDING * np.abs(rough).max()]
            # Sums row by row are the same for equal vectors wherever they stand, which a matrix product doesn't promise.
            scores = (self.vectors[near] * query).sum(axis=1)
            rows = [self.rows[self.bounds[x] : min(self.bounds[x + 1], self.bounds[x] + self.k + 1)] for x in near]
            ids, scores = self.ids[np.concatenate(rows)], np.repeat(scores, [len(x) for x in rows])
            meant = (ids != query_id) & ~(scores < bound)
            ids, scores = ids[meant], scores[meant]
            best = np.lexsort((ids, -scores))[: self.k]
            found.append((np.full(len(best), query_id), ids[best], scores[best]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def drawn_pivots(rows: DataFrame, pivots: int, longest: float) -> np.ndarray:
    """Lifted directions of at most ``pivots`` distinct rows, the first by a hash of their ids.

    Four times as many rows are drawn, as some may be copies of one vector.
    """
    drawn = rows.select("vector", F.xxhash64("id", F.lit(5)).alias("draw"), "id").orderBy("draw", "id").limit(4 * pivots).collect()
    if not drawn:
        return np.empty((0, 0))
    vectors = lifted(np.array([x["vector"] for x in drawn]), longest)
    _, first = np.unique(vectors, axis=0, return_index=True)
    return vectors[np.sort(first)[:pivots]]


def nearest(
    table: DataFrame,
    is_query: str,
    k: int = 20,
    pivots: int = PIVOTS,
    listed: int = LISTED,
    reranked: float = RERANKED,
    least_times: int = LEAST_TIMES,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    group_bytes: int = blocks.GROUP_BYTES,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k largest inner products found for each row that meets ``is_query``.

    A query isn't its own candidate.  Ties go to the smaller id.  Null and
    zero vectors, those holding null or non-finite components, rows without id
    and vectors of another length than most take no part.  Of rows that repeat
    an id, one is the query.
    """
    ship(table.sparkSession)
    good = blocks.usable(table, id_column, vector_column).where(F.exists("vector", lambda x: x != 0))
    good = staged(good)
    longest = float(good.agg(F.max(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))).first()[0] or 1.0) ** 0.5
    directions = drawn_pivots(good, pivots, longest)
    if not len(directions):
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    listed = min(listed, len(directions))
    groups = blocks.packed(good, None, lambda v, _: (v, nearest_pivots(lifted(v, longest), directions, listed)), group_bytes)
    asked = topk.queries_of(good, is_query, id_column)
    found = topk.in_two_rounds(groups, asked, lambda held: InvertedFile(held, directions, k, reranked, least_times * k), lambda v, x: (v, x), k, "double")
    return topk.ranked(found, k)
