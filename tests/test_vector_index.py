"""The inverted-file index: exact searches, recall by probes, pruned reads."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamgraph.operators import vector_index as V


def brute(rows, queries, k, other=False):
    out = []
    for q, v in queries.items():
        v = np.array(v) / np.linalg.norm(v)
        scored = sorted((-float(v @ (np.array(x) / np.linalg.norm(x))), i) for i, x in rows if not (other and i == q))
        out += [(q, r + 1, i, round(-s, 9)) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def found(spark, path, queries, **given):
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in queries.items()], "query_id long, vector array<double>")
    return sorted((r.query_id, r.rank, r.id, round(r.cosine, 9)) for r in V.search(spark, path, df, **given).collect())


@pytest.fixture(scope="module")
def clustered():
    r = np.random.default_rng(3)
    centres = r.normal(size=(40, 12))
    return [(i, (centres[i % 40] + 0.25 * r.normal(size=12)).tolist()) for i in range(1600)]


@pytest.fixture(scope="module")
def index(spark, clustered, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    V.build(spark.createDataFrame(clustered, "vec_id long, embedding array<double>"), path, lists=60)
    return path


QUERIES = range(0, 1600, 97)


def test_exact_search_equals_brute_force(spark, clustered, index):
    queries = {i: clustered[i][1] for i in QUERIES}
    assert found(spark, index, queries, k=7, exact=True) == brute(clustered, queries, 7)
    assert found(spark, index, queries, k=7, exact=True, probes=1, other=True) == brute(clustered, queries, 7, True)
    assert found(spark, index, queries, k=7, probes=60) == brute(clustered, queries, 7)  # all lists
    few = {i: clustered[i][1] for i in (0, 97)}
    assert found(spark, index, few, k=2000, exact=True) == brute(clustered, few, 2000)


def test_recall_rises_with_probes(spark, clustered, index):
    queries = {i: clustered[i][1] for i in QUERIES}
    best = {(q, i) for q, _, i, _ in brute(clustered, queries, 10)}
    recall = {p: len(best & {(q, i) for q, _, i, _ in found(spark, index, queries, k=10, probes=p)}) / len(best) for p in (1, 4, V.n_probes(60), 60)}
    assert recall[1] <= recall[4] <= recall[V.n_probes(60)] <= recall[60] == 1.0
    assert recall[1] > 0.5 and recall[V.n_probes(60)] > 0.95


def test_search_reads_the_probed_lists_only(spark, clustered, index):
    heads = V.centroids_of(spark, index)
    assert (heads[2] > 0).any() and sum(r.n for r in spark.read.parquet(f"{index}/centroids").collect()) == 1600
    q = spark.createDataFrame([(0, clustered[0][1])], "query_id long, query array<double>").withColumn("query", V.unit(F.col("query")))
    visits = V.probed(q, heads, 3).where("turn < 3").select("query_id", "query", "list")
    plan = V._scored(spark, index, visits, 60, 5, False)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [part#" in plan and "PushedFilters: [In(list" in plan
    # the exact search leaves most lists of clustered vectors unread
    floor = min(c for _, r, _, c in brute(clustered, {0: clustered[0][1]}, 7) if r == 7)
    assert 1 <= V.probed(q, heads, 3).where(F.col("bound") >= floor).count() < 20


def test_odd_vectors_and_empty_tables(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 2.0]), (2, [0.0, 3.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [1.0, None]), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (9, [5.0, 5.0])]
    V.build(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), str(tmp_path / "a"))
    kept = [(i, v) for i, v in rows if i in (1, 2, 9)]
    assert found(spark, str(tmp_path / "a"), {1: [3.0, 1.0]}, k=3, exact=True) == brute(kept, {1: [3.0, 1.0]}, 3)
    assert found(spark, str(tmp_path / "a"), {1: [0.0, 0.0], 2: [1.0, 2.0, 3.0]}, exact=True) == []
    V.build(spark.createDataFrame(rows, "vec_id long, embedding array<double>").limit(0), str(tmp_path / "b"))
    assert found(spark, str(tmp_path / "b"), {1: [3.0, 1.0]}, exact=True) == []
    assert [V.n_lists(n) for n in (0, 1, 100, 10_000, 10**9)] == [1, 1, 100, 1500, V.MAX_LISTS]
