"""Streaming limiters and feeds: batches in any order, late events, restarts, timers."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from loamgraph.streaming import limits, timed

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "k string, at timestamp, id long, kind string, who string"


class Source:
    """A folder of micro-batches, and what a stream over it has given so far; each run is a restart from the checkpoint."""

    def __init__(self, spark, folder):
        self.spark, self.folder = spark, folder

    def put(self, rows):
        own = [(k, START + timedelta(microseconds=t), i, kind, who) for k, t, i, kind, who in rows]
        self.spark.createDataFrame(own, SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")

    def run(self, make):
        stream = self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{self.folder}/in")
        out = timed.run_to_folder(self.spark, make(stream), f"{self.folder}/out", f"{self.folder}/checkpoint")
        return sorted((tuple(r) for r in out.withColumn("at", F.unix_micros("at") - F.lit(int(START.timestamp()) * 1_000_000)).collect()), key=str)


def events(seed, n=120):
    """Random events of three keys over about ten minutes, some at equal times, by time."""
    r = random.Random(seed)
    return sorted(((r.choice("aab"), r.choice((1, 7, 15)) * r.randint(0, 40) * 1_000_000, i, None, None) for i in range(n)), key=lambda x: x[1])


def in_batches(rows, seed):
    """Three batches whose events overlap by less than the allowed lateness, each shuffled."""
    r, out = random.Random(seed), [[], [], []]
    for x in rows:
        out[min(2, max(0, int((x[1] + r.randint(-9, 9) * 1_000_000) / 220_000_000)))].append(x)
    for batch in out:
        r.shuffle(batch)
    return out


FLUSH = ("z", 10_000_000_000, 10_000, None, None)


def test_sliding_limit_equals_the_batch_operator(spark, tmp_path):
    rows, source = events(1), Source(spark, str(tmp_path))
    make = lambda s: timed.sliding_limit_stream(s, "k", "at", "id", 60, 4, "20 seconds")
    parts = in_batches(rows, 2)
    seen = []
    for i, batch in enumerate([*parts[:2], [*parts[2], ("a", 1_000_000, 777, None, None), ("b", 5_000_000, 778, None, None)], [FLUSH]]):
        source.put(batch)
        got = source.run(make)
        assert len(got) >= len(seen) and set(seen) <= set(got)  # nothing is given twice or taken back
        seen = got
        if i == 0:
            assert 0 < len(got) < len(batch)  # the newest wait for the watermark
    table = spark.createDataFrame([(k, t, i) for k, t, i, _, _ in rows], "k string, at long, id long")
    expected = limits.sliding_limit(table, "k", F.col("at"), 60, 4).select("k", "at", "id", "in_window", "allowed")
    assert seen == sorted((tuple(r) for r in expected.collect()), key=str)
    assert {r[4] for r in seen} == {True, False}


def test_anchored_breaker_equals_the_batch_operator(spark, tmp_path):
    rows, source = events(3), Source(spark, str(tmp_path))
    make = lambda s: timed.anchored_breaker_stream(s, "k", "at", "id", 60, 5, "20 seconds")
    for batch in (*in_batches(rows, 4), [("a", 2_000_000, 777, None, None), FLUSH], [("a", 10_000_500_000, 778, None, None), ("z", 20_000_000_000, 10_001, None, None)]):
        source.put(batch)
        got = source.run(make)
    table = spark.createDataFrame([(k, float(t), i) for k, t, i, _, _ in [*rows, FLUSH, ("a", 10_000_500_000, 778, None, None)]], "k string, at double, id long")
    expected = limits.anchored_limit(table, "k", "at", 60e6, 5).collect()
    assert sorted((k, at, ok) for k, at, _, ok in got) == sorted((r.k, int(r.at), r.allowed) for r in expected)
    assert {r[3] for r in got} == {True, False}


def deliveries(rows, size, beat, terminal, upto):
    """One pass over all rows of a key by time and id."""
    out, last, history = [], {}, []
    for k, at, i, kind, who in [*sorted(rows, key=lambda x: (x[1], x[2])), (None, upto + 1, None, None, None)]:
        for x in list(last):
            while last[x] + beat < at:
                last[x] += beat
                out.append((rows[0][0], last[x], None, x, "heartbeat"))
        if k is None:
            break
        if kind == "subscribe":
            out += [(k, at, h, who, "replay") for h in history]
            last[who] = at
        elif kind == "unsubscribe":
            last.pop(who, None)
        else:
            history = (history + [i])[-size:]
            out += [(k, at, i, x, "live") for x in last]
            last = {} if kind in terminal else {x: at for x in last}
        if not last and kind in ("unsubscribe", *terminal):
            history = []
    return out


def test_feed_replays_and_beats(spark, tmp_path):
    r = random.Random(6)
    rows = []
    for i in range(90):
        kind = r.choice(("step", "step", "step", "subscribe", "unsubscribe", "done"))
        rows.append((r.choice("ab"), r.randint(0, 600) * 1_000_000, i, kind, r.choice("xyz") if "subscribe" in kind else None))
    source = Source(spark, str(tmp_path))
    make = lambda s: timed.feed_stream(s, "k", "at", "id", "kind", "who", 4, 30, ("done",), "20 seconds")
    for batch in (*in_batches(sorted(rows, key=lambda x: x[1]), 7), [("z", 700_000_000, 1000, "step", None)]):
        source.put(batch)
        got = source.run(make)
    expected = [x for k in "ab" for x in deliveries([y for y in rows if y[0] == k], 4, 30_000_000, ("done",), 680_000_000)]
    assert got == sorted(expected, key=str)
    assert {x[4] for x in got} == {"live", "replay", "heartbeat"}


def test_state_is_cleared_when_windows_have_passed(spark, tmp_path):
    source = Source(spark, str(tmp_path))
    make = lambda s: timed.sliding_limit_stream(s, "k", "at", "id", 60, 4, "20 seconds")
    source.put([("a", 1_000_000, 1, None, None), ("b", 2_000_000, 2, None, None)])
    source.run(make)
    source.put([FLUSH])
    source.run(make)
    source.put([("z", 20_000_000_000, 3, None, None)])
    source.run(make)
    state = spark.read.format("statestore").option("stateVarName", "recent").load(f"{tmp_path}/checkpoint")
    assert {r[0] for r in state.select("key.name").distinct().collect()} <= {"z"}


@pytest.mark.parametrize("rows", [[], [(None, 1, 1, None, None), ("a", 1, 1, None, None)]])
def test_no_events_and_null_keys(spark, tmp_path, rows):
    source = Source(spark, str(tmp_path))
    source.put(rows)
    source.put([FLUSH])
    got = source.run(lambda s: timed.sliding_limit_stream(s, "k", "at", "id"))
    assert [x[0] for x in got] == [x[0] for x in rows if x[0]]
