"""Exact searches by groups of lists and blocks of queries."""

import numpy as np

from loamgraph.operators import vector_index as V

from test_vector_index import brute, found


def test_groups_and_blocks_equal_brute_force(spark, tmp_path, monkeypatch):
    def none(*given):
        raise AssertionError("a row for each query and list")

    monkeypatch.setattr(V, "probed", none)
    monkeypatch.setattr(V, "GROUP", 40)
    monkeypatch.setattr(V, "BLOCK", 5)
    r = np.random.default_rng(6)
    rows = [(i, r.normal(size=8).tolist()) for i in range(300)] + [(1000 - i, [1.0] * 8) for i in range(130)]  # a list of more than three groups
    V.build(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), str(tmp_path), lists=12)
    queries = {i: v for i, v in rows if i % 37 == 0}
    assert found(spark, str(tmp_path), queries, k=6, exact=True, other=True) == brute(rows, queries, 6, True)


def test_groups_hold_about_as_many_rows():
    first, parts, n = V._groups(np.array([10, 70_000, 130_000, 5, 5]))
    assert parts.tolist() == [1, 2, 3, 1, 1] and first.tolist()[:3] == [0, 1, 3] and first[3] == first[4] == 6 and n == 7
