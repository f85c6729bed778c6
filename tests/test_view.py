"""A stored view under random edits against rebuilds; tags and cached snapshots."""

import random

import pytest
from pyspark.sql import functions as F

from loamgraph.operators import view as V

ROW = "key long, uri string, label string, source long, expired double"


def rows_of(df):
    return sorted(tuple(r) for r in df.select("key", "uri", "label", "source", "depth", "is_imported").collect())


def frame(spark, state):
    return spark.createDataFrame([(k, *v) for k, v in sorted(state.items())], ROW)


@pytest.mark.parametrize("seed", [1, 2])
def test_view_equals_a_rebuild_after_edits(spark, tmp_path, seed):
    r = random.Random(seed)
    row = lambda: (f"u{r.randint(0, 25)}", f"label {r.randint(0, 9)}", r.randint(0, 7), r.choice((None, None, None, 5.0)))
    state = {k: row() for k in range(60)}
    imports = {(0, 1), (1, 2), (2, 0), (5, 6)}
    edges = lambda: spark.createDataFrame(sorted(imports), "src long, dst long")
    view = V.EffectiveView(spark, str(tmp_path / "view"), 0)
    view.create(frame(spark, state), edges())
    seq = 0
    for step in range(4):
        feed = []
        for _ in range(r.randint(1, 12)):
            seq, k, new = seq + 1, r.randint(0, 75), row()
            state[k] = new
            feed.append((seq, k, *new))
        old = [(1, 3, "stale", "never", 0, None)] if step else []  # comes again and is passed over
        df = spark.createDataFrame([*feed, *old], f"seq long, {ROW}")
        if step % 2:
            imports ^= {(1, 2), (0, 5), (r.randint(0, 3), r.randint(3, 7))}
            got = view.apply(df, frame(spark, state), edges())
        else:
            got = view.apply(df)
            assert got["touched"] <= len(feed)
        expected = V.rebuilt(frame(spark, state), edges(), 0)
        assert rows_of(view.rows) == rows_of(expected)
        assert sorted(map(tuple, view.conflicts.select("uri", "n", "sources").collect())) == sorted(map(tuple, V.conflicts_of(expected).collect()))
        assert view.seq == seq
        again = view.apply(df)
        assert again == {"changes": 0, "touched": 0, "uris": 0} and rows_of(view.rows) == rows_of(expected)


def test_etag_follows_rows_not_files(spark):
    df = spark.range(500).select("id", F.concat(F.lit("x"), F.col("id")).alias("name"))
    tag = V.etag(df, "id")
    assert tag == V.etag(df.repartition(7).orderBy(F.col("id").desc()), "id") and len(tag) == 32
    others = (df.where("id <> 7"), df.withColumn("name", F.when(F.col("id") == 3, None).otherwise(F.col("name"))), df.withColumn("name", F.when(F.col("id") == 3, "x4").when(F.col("id") == 4, "x3").otherwise(F.col("name"))), df.limit(0))
    assert len({tag, *(V.etag(x, "id") for x in others)}) == 5


def test_snapshot_cache(spark, tmp_path):
    made, now = [], [1000.0]

    def make(n):
        made.append(n)
        return spark.range(n)

    cache = V.SnapshotCache(spark, str(tmp_path / "cache"), now=lambda: now[0])
    assert cache.get("a", 1.5, lambda: make(3)).count() == 3 and cache.get("a", 1.5, lambda: make(4)).count() == 3
    assert cache.get("a", 1.500001, lambda: make(5)).count() == 5 and cache.get("b", 1.5, lambda: make(6)).count() == 6
    now[0] += 300
    assert cache.get("a", 1.5, lambda: make(7)).count() == 3
    now[0] += 1
    assert cache.get("a", 1.5, lambda: make(8)).count() == 8
    assert cache.invalidate("a") == 2 and cache.invalidate("a") == 0
    assert cache.get("a", 1.5, lambda: make(9)).count() == 9 and cache.get("b", 1.5, lambda: make(10)).count() == 10
    (tmp_path / "cache" / V.hashlib.sha256(b"c").hexdigest()[:24] / V.key("c", 2.0) / "9999000-half").mkdir(parents=True)  # a copy that was not finished
    assert cache.get("c", 2.0, lambda: make(2)).count() == 2
    assert made == [3, 5, 6, 8, 9, 10, 2]
