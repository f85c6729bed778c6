"""Migrations: each once, in order, whole or not at all."""

import os

import pytest
from pyspark.sql import functions as F

from loamgraph.operators import migrations as M


def steps(spark, fail=False):
    def split(read):
        rows = read("things")
        return {"kinds": rows.select("kind").distinct(), "things": rows.drop("kind") if not fail else rows.select(F.raise_error(F.lit("stop")).alias("x"))}

    return [
        M.Step(1, "create", lambda read: {"things": spark.createDataFrame([(1, "a"), (2, None)], "id int, name string")}),
        M.add_column(2, "things", "kind", lambda: F.lit(None).cast("string")),
        M.backfill(3, "things", "kind", "concat('k', id % 2)"),
        M.rename_column(4, "things", "name", "label"),
        M.Step(5, "split", split, "kinds of their own"),
        M.drop_table(6, "kinds"),
    ]


def test_steps_are_applied_once_and_resume_after_a_failure(spark, tmp_path):
    own = M.Migrator(spark, str(tmp_path / "db"))
    assert own.apply(steps(spark)[:2]) == ["create", "add_things_kind"] and own.read("things").columns == ["id", "name", "kind"]
    with pytest.raises(Exception, match="stop"):
        own.apply(steps(spark, fail=True))
    assert [e.number for e in own.ledger()] == [1, 2, 3, 4]  # those before the failure hold
    assert own.read("things").columns == ["id", "label", "kind"] and "kinds" not in own.tables()
    again = M.Migrator(spark, str(tmp_path / "db"))
    assert again.apply(steps(spark)[:5]) == ["split"]
    assert sorted(r.kind for r in again.read("kinds").collect()) == ["k0", "k1"] and again.read("things").columns == ["id", "label"]
    assert again.apply(steps(spark)) == ["drop_kinds"] and set(again.tables()) == {"things"}
    before = {d for d, _, _ in os.walk(tmp_path / "db")}
    assert again.apply(steps(spark)) == [] and {d for d, _, _ in os.walk(tmp_path / "db")} == before
    assert again.sweep() > 3 and again.sweep() == 0
    assert sorted(map(tuple, again.read("things").collect())) == [(1, "a"), (2, None)]


def test_changed_repeated_and_late_steps_are_errors(spark, tmp_path):
    own = M.Migrator(spark, str(tmp_path / "db"))
    assert own.apply([]) == [] and own.tables() == {}
    own.apply([s for s in steps(spark) if s.number in (1, 3)][:1])
    with pytest.raises(ValueError, match="differs"):
        own.apply([M.Step(1, "create", lambda read: {}, "otherwise")])
    with pytest.raises(ValueError, match="one number"):
        own.apply([M.drop_table(7, "a"), M.drop_table(7, "b")])
    own.apply([M.drop_table(9, "nothing")])
    with pytest.raises(ValueError, match="comes before"):
        own.apply([M.drop_table(8, "things")])
