"""Coherence repair of many conflicts at once."""

import random
from collections import deque

import pytest

from loamgraph.operators import resolve

EDGE, PAIR = "a long, b long, confidence double", "x long, y long"


def shortest(edges, x, y):
    """Nodes of the smallest shortest path, by breadth-first search with paths in order."""
    near = {}
    for a, b, _ in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    known, queue = {x: [x]}, deque([x])
    while queue:
        node = queue.popleft()
        for n in sorted(near.get(node, ())):
            path = known[node] + [n]
            if n not in known:
                known[n] = path
                queue.append(n)
            elif len(known[n]) == len(path) and path < known[n]:
                known[n] = path
    return known.get(y)


def test_connecting_paths_are_the_smallest_shortest_ones(spark):
    r = random.Random(3)
    edges = [(r.randint(0, 25), r.randint(0, 25), 0.5) for _ in range(45)]
    edges = [e for e in edges if e[0] != e[1]]
    ends = {(r.randint(0, 25), r.randint(0, 25)) for _ in range(40)}
    ends = [(x, y) for x, y in ends if x != y]
    got = {(p.x, p.y): p.nodes for p in resolve.connecting_paths(spark.createDataFrame(edges, EDGE), spark.createDataFrame(ends, PAIR)).collect()}
    assert got == {(x, y): p for x, y in ends if (p := shortest(edges, x, y))}


@pytest.mark.parametrize("seed", [2])
def test_every_removal_is_the_weakest_edge_of_a_shortest_path_in_some_order(spark, seed):
    r = random.Random(seed)
    edges = list({(min(p), max(p)): None for p in ((r.randint(0, 30), r.randint(0, 30)) for _ in range(50)) if p[0] != p[1]})
    edges = [(a, b, r.randint(0, 20) / 20) for a, b in edges]
    conflicts = sorted({(min(p), max(p)) for p in ((r.randint(0, 30), r.randint(0, 30)) for _ in range(12)) if p[0] != p[1]})
    kept, gone = resolve.repair(spark.createDataFrame(edges, EDGE), spark.createDataFrame(conflicts, PAIR))
    left, removed = sorted(map(tuple, kept.collect())), [tuple(g) for g in gone.collect()]
    assert all(shortest(left, x, y) is None for x, y in conflicts)
    assert sorted(left + [g[:3] for g in removed]) == sorted(edges)
    # replay: some order of the removals follows the rule step by step
    now, todo = list(edges), list(removed)
    while todo:
        for g in todo:
            path = shortest(now, g[3], g[4])
            steps = {(min(u, v), max(u, v)) for u, v in zip(path, path[1:])} if path else set()
            if path and min(((c, a, b) for a, b, c in now if (a, b) in steps)) == (g[2], g[0], g[1]):
                now.remove(g[:3])
                todo.remove(g)
                break
        else:
            raise AssertionError(f"no removal of {todo} follows the rule")


def test_many_conflicts_of_a_component_take_few_rounds(spark, monkeypatch):
    """A hub with 1,000 pairs that must not meet: 2,000 edges in one component."""
    n = 1000
    edges = [(0, i, 0.9) for i in range(1, n + 1)] + [(0, n + i, 0.5) for i in range(1, n + 1)]
    rounds = []
    real = resolve.connecting_paths
    monkeypatch.setattr(resolve, "connecting_paths", lambda *a: rounds.append(1) or real(*a))
    kept, gone = resolve.repair(spark.createDataFrame(edges, EDGE), spark.createDataFrame([(i, n + i) for i in range(1, n + 1)], PAIR))
    assert kept.count() == n and {r.confidence for r in gone.collect()} == {0.5}
    assert len(rounds) < 14
