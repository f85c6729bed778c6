"""Limiters and feeds over streams in event time: `transformWithState` with timers.

Micro-batches bring events in any order.  A key holds its events until the watermark has passed them, then takes them by time
and id, so the results equal those of one sorted pass whatever the batches, their order or restarts.  Events at or below the
watermark when they come are late and dropped, as by Spark's own windows.  A key's state is what its policy remembers and the
events between watermark and now; a timer clears it when nothing of it can matter any more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from .limits import _anchored

#: The state store that keeps timers and lists.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PENDING = "at long, id long, kind string, who string"


class InOrder(StatefulProcessor):
    """Hands a key's events to `step` in order of time and id, once the watermark has passed them.

    step(key, rows, upto) gets rows (at in microseconds, id, kind, who) up to the watermark and returns output; idle_at() says
    at which microsecond the key's own state may go if nothing more comes, wake_at() when the key wants to be called at the
    latest (None: no need).
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", _PENDING)
        self.open()

    def open(self) -> None:
        raise NotImplementedError

    def step(self, key, rows: pd.DataFrame, upto: int) -> pd.DataFrame:
        raise NotImplementedError

    def idle_at(self) -> int | None:
        return None

    def wake_at(self) -> int | None:
        return None

    def forget(self) -> None:
        raise NotImplementedError

    def _arm(self, micros: int, mark: int) -> None:
        """A timer at the millisecond after, unless one comes before that; those up to the watermark are about to be done with."""
        due = -(-micros // 1000)
        if not any(mark < 1000 * t <= 1000 * due for t in self.handle.listTimers()):
            self.handle.registerTimer(due)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        for frame in rows:
            frame = frame[frame["micros"] > mark] if mark > 0 else frame
            if len(frame):
                self.pending.appendList([(int(r[0]), int(r[1]), None if r[2] is None else str(r[2]), None if r[3] is None else str(r[3])) for r in frame[["micros", "number", "kind", "who"]].itertuples(index=False, name=None)])
                self._arm(int(frame["micros"].min()), mark)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        held = pd.DataFrame(list(self.pending.get()) if self.pending.exists() else [], columns=["at", "id", "kind", "who"])
        ready = held["at"] <= mark
        rest = held[~ready]
        if ready.any():
            if len(rest):
                self.pending.put(list(rest.itertuples(index=False, name=None)))
            else:
                self.pending.clear()
        out = self.step(key, held[ready].sort_values(["at", "id"]), mark)
        times = [t for t in (int(rest["at"].min()) if len(rest) else None, self.wake_at()) if t is not None]
        idle = self.idle_at()
        if times:
            self._arm(min(times), mark)
        elif idle is not None and idle > mark:
            self._arm(idle, mark)
        else:
            self.forget()
        if len(out):
            yield out

    def close(self) -> None:
        pass


class Sliding(InOrder):
    """Counts of the trailing window; remembers the window's times and how many events each has."""

    def __init__(self, seconds: float, limit: int):
        self.width, self.limit = int(seconds * 1_000_000), limit

    def open(self) -> None:
        self.recent = self.handle.getListState("recent", "at long, n long")

    def step(self, key, rows, upto):
        if not len(rows):
            return rows
        before = list(self.recent.get()) if self.recent.exists() else []
        at, n = np.unique(rows["at"].to_numpy(np.int64), return_counts=True)
        times = np.concatenate([np.array([x[0] for x in before], np.int64), at])
        total = np.concatenate([[0], np.cumsum(np.concatenate([np.array([x[1] for x in before], np.int64), n]))])
        own = rows["at"].to_numpy(np.int64)
        seen = total[np.searchsorted(times, own, side="right")] - total[np.searchsorted(times, own - self.width, side="right")]
        keep = np.flatnonzero(times > int(at[-1]) - self.width)
        self.recent.put(list(zip(times[keep].tolist(), np.diff(total)[keep].tolist())))
        return pd.DataFrame({"key": key[0], "at": own, "id": rows["id"].to_numpy(), "in_window": seen, "allowed": seen <= self.limit})

    def idle_at(self):
        last = list(self.recent.get())[-1:] if self.recent.exists() else []
        return last[0][0] + self.width if last else None

    def forget(self) -> None:
        self.recent.clear()


class Anchored(InOrder):
    """Windows that begin with the first event after the last window ran out; remembers the open window's start and count."""

    def __init__(self, seconds: float, limit: int):
        self.seconds, self.limit = seconds, limit

    def open(self) -> None:
        self.window = self.handle.getValueState("window", "start long, seen long")

    def step(self, key, rows, upto):
        if not len(rows):
            return rows
        start, seen = self.window.get() if self.window.exists() else (None, 0)
        allowed, start, seen = _anchored(rows["at"].tolist(), start, seen, int(self.seconds * 1_000_000), self.limit)
        self.window.update((int(start), int(seen)))
        return pd.DataFrame({"key": key[0], "at": rows["at"].to_numpy(), "id": rows["id"].to_numpy(), "allowed": allowed})

    def idle_at(self):
        return self.window.get()[0] + int(self.seconds * 1_000_000) if self.window.exists() else None

    def forget(self) -> None:
        self.window.clear()


class Feed(InOrder):
    """Deliveries of a key's events to its subscribers, with replay, heartbeats and a bounded history.

    kind subscribe and unsubscribe concern `who`; everything else is an event.  A new subscriber gets the last `size` events,
    then each one as it comes, and a heartbeat after `beat` seconds without a delivery; an event of a terminal kind ends all
    subscriptions of the key.  Without subscribers the history goes, too.
    """

    def __init__(self, size: int, beat: float, terminal: tuple[str, ...]):
        self.size, self.beat, self.terminal = size, int(beat * 1_000_000), terminal

    def open(self) -> None:
        self.history = self.handle.getListState("history", "id long")
        self.last = self.handle.getMapState("last", "who string", "at long")

    def step(self, key, rows, upto):
        last = {k[0]: v[0] for k, v in self.last.iterator()} if self.last.exists() else {}
        history = [x[0] for x in self.history.get()] if self.history.exists() else []
        out = []

        def beats(to: int) -> None:
            for who in sorted(last):
                while last[who] + self.beat < to:
                    last[who] += self.beat
                    out.append((key[0], last[who], None, who, "heartbeat"))

        for at, id_, kind, who in rows.itertuples(index=False, name=None):
            beats(at)
            if kind == "subscribe":
                out += [(key[0], at, i, who, "replay") for i in history]
                last[who] = at
            elif kind == "unsubscribe":
                last.pop(who, None)
            else:
                history = [*history, id_][-self.size :]
                out += [(key[0], at, id_, x, "live") for x in sorted(last)]
                last = {} if kind in self.terminal else dict.fromkeys(last, at)
            if not last and (kind == "unsubscribe" or kind in self.terminal):
                history = []
        beats(upto + 1)
        self.last.clear()
        for who, at in last.items():
            self.last.updateValue((who,), (int(at),))
        if history:
            self.history.put([(int(i),) for i in history])
        else:
            self.history.clear()
        return pd.DataFrame(out, columns=["key", "at", "id", "who", "delivery"]).astype({"id": "Int64"})

    def wake_at(self):
        times = [v[0] for _, v in self.last.iterator()] if self.last.exists() else []
        return min(times) + self.beat if times else None

    def forget(self) -> None:
        """A history waits for subscribers; what is left without any is cleared as they go."""


def _in_order(events: DataFrame, key: str, time: str, id_col: str, late: str, processor: InOrder, columns: str, kind: str | None = None, who: str | None = None) -> DataFrame:
    """events: a stream with a timestamp column; its watermark is `late` behind the newest event."""
    own = events.where(F.col(key).isNotNull() & F.col(time).isNotNull()).withWatermark(time, late)
    text = lambda c: F.col(c).cast("string") if c else F.lit(None).cast("string")
    rows = own.select(F.col(key).alias("name"), F.col(time).alias("time"), F.unix_micros(time).alias("micros"), F.col(id_col).cast("long").alias("number"), text(kind).alias("kind"), text(who).alias("who"))
    schema = f"key {events.schema[key].dataType.simpleString()}, at long, id long, {columns}"
    out = rows.groupBy("name").transformWithStateInPandas(processor, schema, "Append", "EventTime")
    names = [c for c in out.columns if c not in ("key", "at", "id")]
    return out.select(F.col("key").alias(key), F.timestamp_micros("at").alias(time), F.col("id").alias(id_col), *names)


def sliding_limit_stream(events: DataFrame, key: str, time: str, id_col: str, seconds: float = 60.0, limit: int = 100, late: str = "30 seconds") -> DataFrame:
    """key, time, id, in_window (events of the key in the trailing window, itself, its equals and rejected ones included) and allowed."""
    return _in_order(events, key, time, id_col, late, Sliding(seconds, limit), "in_window long, allowed boolean")


def anchored_breaker_stream(events: DataFrame, key: str, time: str, id_col: str, seconds: float = 60.0, limit: int = 50, late: str = "30 seconds") -> DataFrame:
    """key, time, id and allowed; windows are anchored at a key's first event after the last one ran out."""
    return _in_order(events, key, time, id_col, late, Anchored(seconds, limit), "allowed boolean")


def feed_stream(events: DataFrame, key: str, time: str, id_col: str, kind: str, who: str, size: int = 100, beat: float = 30.0, terminal: tuple[str, ...] = (), late: str = "30 seconds") -> DataFrame:
    """key, time, id, who and delivery (replay, live or heartbeat); see Feed."""
    return _in_order(events, key, time, id_col, late, Feed(size, beat, terminal), "who string, delivery string", kind, who)


def run_to_folder(spark: SparkSession, stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Runs a stream over what is there, adds its rows to the Parquet folder `out`, and returns all of them; it goes on from the checkpoint folder."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    try:
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(stream.schema).parquet(out)
