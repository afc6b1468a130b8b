"""Exact top-k against all products, recall of the permutation index, and odd vectors."""

import duckdb
import numpy as np
import pytest

from adtally.llm import blocks, permutation_index, topk
from adtally.llm.queries import QUERIES
from adtally.llm.sql import SQL
from tests.oracle import differences


def plain_top(vectors, queries, k):
    out = {}
    for q in queries:
        scored = [(-sum(a * b for a, b in zip(vectors[q], v, strict=True)), i) for i, v in vectors.items() if i != q]
        out[q] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


def by_query(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def vectors_of(spark, vectors):
    return spark.createDataFrame([(i, list(map(float, v))) for i, v in vectors.items()], "vec_id long, embedding array<double>")


@pytest.mark.parametrize("spread", [0.05, 3.0])
def test_exact_products(spark, spread):
    """Lengths alike and lengths far apart, several groups, many ties and copies."""
    draw = np.random.default_rng(4)
    base = draw.normal(size=(900, 24)) * np.exp(draw.normal(size=(900, 1)) * spread)
    base[300:420] = base[7]
    base = np.round(base, 2)
    vectors = {i: v for i, v in enumerate(base)}
    whole = {i: [int(np.floor(1024 * x)) for x in v] for i, v in vectors.items()}
    rows = topk.largest_products(vectors_of(spark, vectors), "vec_id % 9 = 0", k=6, group_bytes=24 * 8 * 150).collect()
    assert by_query(rows) == plain_top(whole, range(0, 900, 9), 6)


def test_large_whole_numbers(spark):
    """Products beyond the whole numbers a double holds."""
    vectors = {i: [float(2**29 + i), float(2**28 - 3 * i)] for i in range(40)}
    rows = topk.largest_products(vectors_of(spark, vectors), "vec_id % 10 = 0", k=5, scale=1.0).collect()
    assert by_query(rows) == plain_top({i: list(map(int, v)) for i, v in vectors.items()}, range(0, 40, 10), 5)


def odd_vectors(spark):
    rows = [
        (0, [1.0, 0.0], "x"), (1, [0.5, 0.5], "x"), (1, [0.5, 0.5], "x"), (2, None, "x"), (3, [None, 1.0], "x"), (4, [float("nan"), 1.0], "x"),
        (5, [float("inf"), 1.0], "x"), (6, [0.0, 0.0], "x"), (7, [1.0], "x"), (8, [], "x"), (None, [1.0, 1.0], "x"), (20, [1.0, 0.25], None),
    ]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")


def test_odd_vectors(spark):
    table = odd_vectors(spark)
    found = by_query(topk.largest_products(table, "vec_id % 20 = 0", k=10).collect())
    assert found == {0: [(20, 1024 * 1024), (1, 512 * 1024), (1, 512 * 1024), (6, 0)], 20: [(0, 1024 * 1024), (1, 640 * 1024), (1, 640 * 1024), (6, 0)]}
    near = by_query(permutation_index.nearest(table, "vec_id % 20 = 0", k=10).collect())
    assert near == {0: [(20, 1.0), (1, 0.5), (1, 0.5)], 20: [(0, 1.0), (1, 0.625), (1, 0.625)]}
    for search in (topk.largest_products, permutation_index.nearest):
        assert search(table.limit(0), "vec_id % 20 = 0").count() == 0
        assert search(table.where("vec_id = 2"), "vec_id % 20 = 0").count() == 0
        assert search(table.where("vec_id = 0"), "vec_id % 20 = 0").count() == 0


def recall(found, vectors, k):
    ids = sorted(vectors)
    table = np.array([vectors[i] for i in ids])
    hit = total = 0
    for q, near in found.items():
        scores = np.round(table @ np.array(vectors[q]), 12)
        order = [ids[i] for i in np.lexsort((ids, -scores)) if ids[i] != q][:k]
        hit += len({i for i, _ in near} & set(order))
        total += len(order)
    return hit / total


def test_recall(spark):
    """Half of the rows are copies of one vector, and groups are larger than what is reranked."""
    draw = np.random.default_rng(1)
    centres = draw.normal(size=(40, 32))
    base = centres[draw.integers(0, 40, 4000)] + draw.normal(size=(4000, 32))
    base[::2] = base[0]
    base /= np.sqrt((base**2).sum(axis=1, keepdims=True))
    vectors = dict(enumerate(base))
    rows = permutation_index.nearest(vectors_of(spark, vectors), "vec_id % 20 = 1", k=20, group_bytes=32 * 8 * 2000).collect()
    found = by_query(rows)
    assert len(found) == 200 and all(len(x) == 20 for x in found.values())
    assert recall(found, vectors, 20) >= 0.9
    assert all(abs(s - float(base[q] @ base[i])) < 1e-12 for q, near in found.items() for i, s in near)


@pytest.mark.parametrize("sigma", [0.5, 1.5])
def test_recall_of_unequal_lengths(spark, sigma):
    """Long rows have large products with queries they aren't near to in angle."""
    draw = np.random.default_rng(2)
    base = draw.normal(size=(6000, 32))
    base *= np.exp(sigma * draw.normal(size=(6000, 1))) / np.sqrt((base**2).sum(axis=1, keepdims=True))
    vectors = dict(enumerate(base))
    rows = permutation_index.nearest(vectors_of(spark, vectors), "vec_id % 40 = 1", k=20, group_bytes=32 * 8 * 3000).collect()
    found = by_query(rows)
    assert len(found) == 150 and all(len(x) == 20 for x in found.values())
    assert recall(found, vectors, 20) >= 0.95


def test_small_table_recall(spark, root):
    vectors = dict(duckdb.sql(f"select vec_id, embedding from '{root}/embeddings.parquet'").fetchall())
    found = by_query(QUERIES["op2_permutation_search"](spark, root).collect())
    assert sorted(found) == [i for i in sorted(vectors) if i % 20 == 0]
    assert recall(found, vectors, 20) >= 0.95  # the index answers here too: 100 of 500 vectors are reranked


def test_the_first_round_is_shared_by_tasks(spark, monkeypatch):
    """Copies of the first group share the queries, and any number of them finds the same."""
    draw = np.random.default_rng(6)
    table = vectors_of(spark, {i: v for i, v in enumerate(draw.normal(size=(1500, 16)).tolist())})
    found = []
    for rows, copies in ((256, 64), (8, 64), (8, 1)):
        monkeypatch.setattr(topk, "ASKED_ROWS", rows)
        monkeypatch.setattr(topk, "FIRST_COPIES", copies)
        found.append(sorted(map(tuple, permutation_index.nearest(table, "vec_id % 20 = 0", k=5, group_bytes=16 * 8 * 500).collect())))
    assert found[0] == found[1] == found[2] and len(found[0]) == 75 * 5


def test_conditions_name_the_id_as_it_is(spark):
    table = vectors_of(spark, {i: [1.0 + i, 2.0] for i in range(40)}).withColumnRenamed("vec_id", "i")
    rows = topk.largest_products(table, "i in (10, 20) and i % 3 <> 0 and 'i' = 'i'", k=2, id_column="i").collect()
    assert {r.query_id for r in rows} == {10, 20}


def test_rotation_keeps_products(spark):
    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 3), 1.0]) for i in range(50)], "id long, vector array<double>")
    turn = topk.rotation(topk.second_moments(blocks.usable(rows, "id", "vector")))
    assert np.allclose(turn.T @ turn, np.eye(3))


def test_against_sql(spark, root):
    assert differences(spark, QUERIES["op6_norm_topk"], SQL["op6_norm_topk"], root) is None
