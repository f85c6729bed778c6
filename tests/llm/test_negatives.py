"""Hard negatives against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamgraph.llm import negatives


def brute(rows, is_anchor, positives=5, count=10):
    """rows: id, label, whole numbers."""
    out = []
    for a, label, v in dict.fromkeys((i, x, tuple(v)) for i, x, v in rows if is_anchor(i)):
        scored = [(-sum(p * q for p, q in zip(v, w)), i, x) for i, x, w in rows if i != a and len(w) == len(v)]
        for s, p, _ in sorted(r for r in scored if r[2] == label)[:positives]:
            fits = sorted(r for r in scored if r[2] != label and 30 * -s <= 100 * -r[0] <= 90 * -s)
            out += [(a, p, k + 1, i, -s, -t) for k, (t, i, _) in enumerate(fits[:count])]
    return sorted(out)


def run(spark, rows, **given):
    df = spark.createDataFrame([(i, x, None if v is None else [float(y) if y is not None else None for y in v], 1, "n") for i, x, v in rows], "vec_id long, label string, embedding array<double>, window int, no string")
    return sorted(tuple(x) for x in negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, scale=1, **given).collect())


@pytest.mark.parametrize("dims", [2, 7])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, dims):
    for name, value in (("LEAST", 40), ("MOST", 60), ("ANCHORS", 9), ("STRIPE", 2), ("SAMPLE", 64)):
        monkeypatch.setattr(negatives, name, value)
    r = np.random.default_rng(dims)
    whole = r.integers(-40, 60, size=(400, dims))
    whole[50:90] = whole[50]  # equal vectors and scores
    rows = [(i, "abc"[i % 3] if i % 17 else "rare", v.tolist()) for i, v in enumerate(whole)]
    rows += [rows[10], rows[10], rows[11], (30, "b", rows[31][2]), (401, "a", [0] * dims), (410, "a", [0] * dims), (420, "lonely", rows[5][2])]
    odd = [(None, "a", rows[0][2]), (500, None, rows[0][2]), (510, "a", None), (520, "a", []), (530, "a", [None] * dims), (540, "a", [float("nan")] * dims), (550, "a", [float("inf")] * dims)]
    other = [(600 + i, "ab"[i % 2], [i, -i, 3][: 3 if dims != 3 else 2]) for i in range(25)]
    assert run(spark, rows + odd + other) == brute(rows + other, lambda i: i % 10 == 0)


def test_few_rows_and_large_numbers(spark):
    assert run(spark, []) == []
    assert run(spark, [(10, "a", [5, 5])]) == []
    assert run(spark, [(10, "a", [5, 5]), (11, "a", [4, 4]), (12, "b", [-1, 3])]) == brute([(10, "a", [5, 5]), (11, "a", [4, 4]), (12, "b", [-1, 3])], lambda i: i == 10)
    r = np.random.default_rng(1)
    rows = [(i, "ab"[i % 2], [(1 << 29) + int(x) for x in r.integers(0, 1 << 20, 4)]) for i in range(60)]
    rows += [(i, "ab"[i % 2], [int(x) for x in r.integers(1 << 27, 1 << 29, 4)]) for i in range(60, 120)]
    assert run(spark, rows) == brute(rows, lambda i: i % 10 == 0) != []
    with pytest.raises(Exception, match="may not fit a long"):
        run(spark, [(10, "a", [1 << 40] * 2), (11, "a", [1 << 40] * 2)])


def test_bounds_rule_out_most_rows_and_no_right_one():
    r = np.random.default_rng(2)
    points = r.normal(size=(6000, 32))
    whole = np.floor(256 * points / np.sqrt((points**2).sum(axis=1))[:, None]).astype(np.int64)
    book = negatives.fit(whole[:4096])
    code, rest = negatives.encode(whole, book)
    heads = np.concatenate([book[m, code[:, m]] for m in range(16)], axis=1)
    assert (np.sqrt(((whole - heads) ** 2).sum(axis=1)) <= rest).all()
    block = {"ids": np.arange(6000), "names": ["a", "b"], "label": np.arange(6000, dtype=np.int32) % 2, "vectors": whole, "code": code, "rest": rest}
    asked = {"ids": np.arange(20), "names": ["a", "b"], "label": np.arange(20, dtype=np.int32) % 2, "vectors": whole[:20]}
    windows = negatives.Windows(np.arange(20), np.full(20, negatives.NONE), np.full(20, 25_000), 10, 20)
    seen = [0, 0]
    negatives.scan(asked, block, book, windows, False, seen)
    assert seen[0] == 20 * 6000 and seen[1] < 0.15 * seen[0]
    for a in range(20):
        best = sorted((-int(whole[a] @ whole[i]), i) for i in range(6000) if i % 2 != a % 2 and whole[a] @ whole[i] <= 25_000)[:10]
        assert [(-s, i) for s, i in zip(windows.score[a].tolist(), windows.id[a].tolist())] == best
