"""Evidence and classes that are dated after the time of the query, against the SQL and by hand."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from loamgraph.functions import scores as S
from loamgraph.plans import catalog  # noqa: F401  registers all queries
from loamgraph.plans import registry


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """Parts whose keys date their classes before and after the queries' time."""
    folder = tmp_path_factory.mktemp("parts")
    keys = ", ".join(f"({k}::BIGINT, {1 + i % 50})" for i, k in enumerate([*range(0, 70, 7), *range(9_780, 9_830), *range(9_990, 10_030), *range(1_000_000, 1_000_700)]))
    duckdb.sql(f"COPY (SELECT p_partkey, 'red gear' AS p_name, 'B' AS p_brand, 'T' AS p_type, p_size::INTEGER AS p_size FROM (VALUES {keys}) t(p_partkey, p_size)) TO '{folder}/part.parquet'")
    return str(folder)


@pytest.mark.parametrize("name, most", [("evidence_age_score", 2.0**100), ("confidence_decay_pass", 1.0)])
def test_query_equals_sql(spark, parts, name, most):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{parts}/part.parquet'")
    got = sorted(tuple(r) for r in registry.QUERIES[name](spark, parts).collect())
    assert got == sorted(con.execute(registry.ORACLES[name]).fetchall()) and max(r[1] for r in got) >= most


def test_the_function_still_clamps(spark):
    day, s = 86400.0, F.col("s")
    rows = spark.createDataFrame([(90 * day,), (0.0,), (-90 * day,), (None,), (-1e12,)], "s double").select(S.evidence_age_score(s), S.evidence_growth(s)).collect()
    assert [tuple(r) for r in rows] == [(0.5, 0.5), (1.0, 1.0), (1.0, 2.0), (1.0, 1.0), (1.0, math.inf)]
