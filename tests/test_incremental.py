"""Components under edits against recomputation."""

import os
import random

import pytest

from loamgraph.operators import incremental as I

PAIR = "a long, b long"


def recomputed(pairs):
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


def edits(r, now, n):
    """Pairs to add and to remove: new ones, present ones, absent ones, self loops, turned ones, some in both."""
    fresh = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(r.randint(0, n))]
    present = r.sample(sorted(now), min(len(now), r.randint(0, n)))
    added = fresh + present[:1]
    removed = [(b, a) for a, b in present] + [(100, 101)] + fresh[:1]
    return added, removed


def after(now, added, removed):
    pair = lambda rows: {(min(p), max(p)) for p in rows if p[0] != p[1]}
    return (now - (pair(removed) - pair(added))) | pair(added)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_updates_equal_recomputation(spark, seed):
    r = random.Random(seed)
    now = after(set(), [(r.randint(0, 60), r.randint(0, 60)) for _ in range(40)], [])
    pairs = spark.createDataFrame(sorted(now), "u long, v long")
    comps = spark.createDataFrame(sorted(recomputed(now).items()), "node long, component long")
    for _ in range(3):
        added, removed = edits(r, now, 9)
        got = I.update(pairs, comps, spark.createDataFrame(added, PAIR), spark.createDataFrame([*removed, (None, 1)], PAIR))
        before, now = recomputed(now), after(now, added, removed)
        expected = recomputed(now)
        assert sorted((x.u, x.v) for x in got.pairs.collect()) == sorted(now)
        assert {x.node: x.component for x in got.components.collect()} == expected
        differ = {x: (before.get(x), expected.get(x)) for x in {*before, *expected} if before.get(x) != expected.get(x)}
        assert {x.node: (x.before, x.after) for x in got.changed.collect()} == differ
        stale, made = I.cluster_changes(got.changed, got.components)
        assert {x.cluster for x in stale.collect()} == {c for p in differ.values() for c in p if c is not None}
        by = {}
        for x, c in expected.items():
            by.setdefault(c, []).append(x)
        assert {x.cluster: (x.size, x.members) for x in made.collect()} == {c: (len(m), sorted(m)) for c, m in by.items() if c in {x.cluster for x in stale.collect()}}
        pairs, comps = spark.createDataFrame(sorted(now), "u long, v long"), spark.createDataFrame(sorted(expected.items()), "node long, component long")


def test_store_rewrites_touched_parts_only(spark, tmp_path):
    own = I.Components(spark, str(tmp_path / "state"))
    now = {(10 * i, 10 * i + 1) for i in range(300)}
    own.create(spark.createDataFrame(sorted(now), PAIR))
    files = lambda: {f"{d}/{f}": os.stat(f"{d}/{f}").st_mtime_ns for d, _, names in os.walk(tmp_path / "state") for f in names if f.startswith("part-")}
    for added, removed in (([(0, 10), (5, 10)], [(20, 21)]), ([], [(0, 10), (30, 31)]), ([(7, 8)], []), ([(7, 8)], [(30, 31)])):
        before = files()
        changed = own.apply(spark.createDataFrame(added, PAIR), spark.createDataFrame(removed, PAIR))
        assert changed.count() < 10
        now = after(now, added, removed)
        assert sorted((x.u, x.v) for x in own.pairs.collect()) == sorted(now)
        assert {x.node: x.component for x in own.components.collect()} == recomputed(now)
        same = {f for f, t in before.items() if files().get(f) == t}
        assert len(same) > 0.7 * len(before)
    assert own.apply(spark.createDataFrame([], PAIR), spark.createDataFrame([], PAIR)).count() == 0


def test_only_touched_components_are_made_anew(spark, monkeypatch):
    seen = []
    real = I.connected_components
    monkeypatch.setattr(I, "connected_components", lambda e, *a: seen.append(e.count()) or real(e, *a))
    pairs = [(10 * i, 10 * i + k) for i in range(200) for k in (1, 2, 3)]
    state = recomputed(pairs)
    got = I.update(spark.createDataFrame(pairs, "u long, v long"), spark.createDataFrame(sorted(state.items()), "node long, component long"), spark.createDataFrame([(0, 50)], PAIR), spark.createDataFrame([(100, 101)], PAIR))
    assert got.components.count() == 799 and seen == [2, 1]  # the other pairs of one component; one pair of component numbers


def test_names_as_nodes_and_an_empty_state(spark):
    none = spark.createDataFrame([], "u string, v string")
    got = I.update(none, spark.createDataFrame([], "node string, component string"), spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y"), ("z", "z")], "a string, b string"), spark.createDataFrame([], "a string, b string"))
    assert {x.node: x.component for x in got.components.collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
