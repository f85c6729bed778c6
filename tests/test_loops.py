"""Components that are kept up where pairs have equal ends or come in both directions."""

import random

import duckdb
import pytest

from loamgraph.operators import incremental as I
from loamgraph.plans import catalog  # noqa: F401  registers all queries
from loamgraph.plans import registry

from test_incremental import PAIR, recomputed


@pytest.mark.parametrize("seed", [1, 2])
def test_a_loop_keeps_its_node(spark, seed):
    r = random.Random(seed)
    some = lambda n: [(r.randint(0, 30), r.randint(0, 30)) for _ in range(n)] + [(x := r.randint(0, 30), x), (r.randint(40, 45),) * 2]
    both = lambda rows: {(min(p), max(p)) for p in rows}
    own, now = I.kept_up(spark.createDataFrame(first := some(12), PAIR), loops=True), both(first)
    for _ in range(3):
        added, removed = some(4), [*r.sample(sorted(now), len(now) // 2), (50, 50)]
        before = recomputed(now)
        now = (now - (both(removed) - both(added))) | both(added)
        changed = own.apply(spark.createDataFrame(added, PAIR), spark.createDataFrame([*removed, (None, 1)], PAIR)).collect()
        expected = recomputed(now)
        assert {x.node: x.component for x in own.components.collect()} == expected and own.components.count() == len(expected)
        assert sorted((x.u, x.v) for x in own.pairs.collect()) == sorted(now)
        assert {x.node: (x.before, x.after) for x in changed} == {x: (before.get(x), expected.get(x)) for x in {*before, *expected} if before.get(x) != expected.get(x)}


def test_query_equals_sql_with_loops_and_turned_edges(spark, tmp_path):
    lines = [(100007, 7, 50, "N"), (100008, 8, 48, "N"), (100009, 9, 49, "R"), (100001, 2, 50, "R"), (100002, 1, 48, "N"), (100003, 4, 48, "R"), (100004, 3, 50, "N"), (5, 6, 49, "A"), (5, 5, 50, "R")]
    con = duckdb.connect()
    values = ", ".join(f"({o}::BIGINT, {p}::BIGINT, 1::BIGINT, {i}::INTEGER, {q}::DOUBLE, '{flag}', 'O', TIMESTAMP '1996-01-01')" for i, (o, p, q, flag) in enumerate(lines))
    con.execute(f"COPY (SELECT * FROM (VALUES {values}) t(l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_returnflag, l_linestatus, l_shipdate)) TO '{tmp_path}/lineitem.parquet'")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    got = registry.QUERIES["components_kept_up"](spark, str(tmp_path)).collect()
    assert sorted((x.node, x.component) for x in got) == sorted(con.execute(registry.ORACLES["components_kept_up"]).fetchall())
    assert {x.node for x in got} == {100007, 100008, 100001, 100002, 100003, 100004, 5, 100006}
