"""Greedy one-to-one matching against the order over all pairs."""

import random

import pytest

from loamgraph.operators import resolve


def greedy(pairs):
    rows, cols, out = set(), set(), []
    for score, a, b in sorted((-s, a, b) for a, b, s in pairs):
        if a not in rows and b not in cols:
            rows.add(a)
            cols.add(b)
            out.append((a, b, -score))
    return sorted(out)


def run(spark, pairs):
    return sorted(map(tuple, resolve.greedy_match(spark.createDataFrame(pairs, "a long, b long, score double")).collect()))


@pytest.mark.parametrize("plain", [0, 3])
@pytest.mark.parametrize("seed", [1, 2])
def test_random_pairs(spark, monkeypatch, plain, seed):
    monkeypatch.setattr(resolve, "PLAIN_ROUNDS", plain)
    r = random.Random(seed)
    pairs = list({(r.randint(0, 25), r.randint(0, 25)): r.randint(0, 12) / 4 for _ in range(150)}.items())
    pairs = [(a, b, s) for (a, b), s in pairs]
    assert run(spark, pairs) == greedy(pairs)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    """Pairs 0-0, 1-0, 1-1, 2-1, ... with rising scores, and some with falls in between."""
    n = 20_000
    chain = [((i + 1) // 2, i // 2, float(i if i % 7000 else 10**6 - i)) for i in range(n)]
    steps = []
    real = resolve.cut
    monkeypatch.setattr(resolve, "cut", lambda df: steps.append(1) or real(df))
    assert run(spark, chain) == greedy(chain)
    assert len(steps) < 60


def test_nothing_and_repeats(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, 1, 0.25), (1, 1, 0.5), (2, 1, 0.5)]) == [(1, 1, 0.5)]
