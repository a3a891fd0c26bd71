"""Neighbours of ids that ask more than once, against brute force."""

import math

import numpy as np
import pytest

from loglake.llm import neighbours


@pytest.mark.parametrize("rows, block", [(neighbours.SLICE_ROWS, neighbours.QUERY_BLOCK), (3, 1)])
def test_repeated_query_rows(spark, monkeypatch, rows, block):
    """Copies of a query's row, ids with several vectors, copies of candidates; whole numbers, so that scores tie and are exact."""
    monkeypatch.setattr(neighbours, "SLICE_ROWS", rows)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", block)
    rng, k = np.random.default_rng(5), neighbours.K
    rows = [(i, rng.integers(-3, 4, 6).astype(float).tolist()) for i in range(1, 100)]
    rows += [rows[19]] * 25  # id 20, 26 times
    rows += [(40, rng.integers(-3, 4, 6).astype(float).tolist()) for _ in range(2)] + [rows[39]] * 2  # three vectors
    rows += [rows[6]] * 3 + [(7, rng.integers(-3, 4, 6).astype(float).tolist())] + [rows[10]] * 30  # candidates
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for r in neighbours.search(df, recall=2.0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {20, 40, 60, 80}
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    for q, near in got.items():
        best = (x @ np.unique(x[ids == q], axis=0).T).max(1)
        others = np.flatnonzero(ids != q)
        want = others[np.lexsort((ids[others], -best[others]))[:k]]
        assert sorted(near) == [(n + 1, int(ids[w]), float(best[w])) for n, w in enumerate(want)]


def test_vectors_that_take_no_part(spark):
    """Null, zero, non-finite and odd-length vectors, null ids, fewer candidates than k, an empty table, clashing columns."""
    schema = "vec_id long, embedding array<double>, part int, v string, kind int, label int"
    assert neighbours.search(spark.createDataFrame([], schema)).count() == 0
    vectors = [(20, [1.0, 0.0]), (3, [2.0, 1.0]), (4, [2.0, 5.0]), (60, [0.0, 1.0]), (1, None), (40, [0.0, 0.0]), (5, [math.nan, 1.0]), (80, [math.inf, 1.0]), (6, [None, 1.0]), (7, [9.0, 9.0, 9.0]), (None, [7.0, 7.0]), (8, [])]
    got = sorted(tuple(r) for r in neighbours.search(spark.createDataFrame([(*r, 1, "x", 2, 3) for r in vectors], schema)).collect())
    assert got == [(20, 1, 3, 2.0), (20, 2, 4, 2.0), (20, 3, 60, 0.0), (60, 1, 4, 5.0), (60, 2, 3, 1.0), (60, 3, 20, 0.0)]
    alone = spark.createDataFrame([(20, [1.0, 2.0], 1, "x", 2, 3)], schema)
    assert neighbours.search(alone).count() == 0
