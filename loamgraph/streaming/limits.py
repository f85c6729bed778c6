"""Limiters and feeds over event streams, in batch and streaming form."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def sliding_limit(events: DataFrame, key: str, micros: Column, seconds: int = 60, limit: int = 100) -> DataFrame:
    """events with in_window (events of the key in the trailing window, itself and rejected ones included) and allowed."""
    w = Window.partitionBy(key).orderBy("_micros").rangeBetween(-seconds * 1_000_000 + 1, 0)
    return events.withColumn("_micros", micros).withColumn("in_window", F.count("*").over(w)).withColumn("allowed", F.col("in_window") <= limit).drop("_micros")


def _anchored(times: list[float], start: float | None, seen: int, seconds: float, limit: int) -> tuple[list[bool], float | None, int]:
    out = []
    for t in times:
        if start is None or t - start >= seconds:
            start, seen = t, 0
        seen += 1
        out.append(seen <= limit)
    return out, start, seen


def anchored_limit(events: DataFrame, key: str, time: str, seconds: float = 60.0, limit: int = 50) -> DataFrame:
    """Batch: windows of a key begin with the first event after the last window ran out; key, time, allowed.

    Events come sorted by key and time, and only the open window is carried, so a task never holds a key's events.
    """
    kind = events.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, start, seen = None, None, 0
        for batch in batches:
            keys, times, allowed = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for k, t in zip(keys, times):
                if now is None or now[0] != k:
                    now, start, seen = (k,), None, 0
                (ok,), start, seen = _anchored([t], start, seen, seconds, limit)
                allowed.append(ok)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(allowed, pa.bool_())], [key, time, "allowed"])

    ordered = events.select(key, F.col(time).cast("double").alias(time)).repartition(key).sortWithinPartitions(key, time)
    return ordered.mapInArrow(run, f"{key} {kind}, {time} double, allowed boolean")


def anchored_limit_stream(events: DataFrame, key: str, time: str, seconds: float = 60.0, limit: int = 50) -> DataFrame:
    """The same over a stream; the state of a key is its window's start and count."""
    kind = events.schema[key].dataType.simpleString()

    def run(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, seen = state.get if state.exists else (None, 0)
        for frame in frames:
            frame = frame.sort_values(time)
            allowed, start, seen = _anchored(frame[time].tolist(), start, seen, seconds, limit)
            yield pd.DataFrame({key: [keys[0]] * len(frame), time: frame[time], "allowed": allowed})
        state.update((start, seen))

    return events.select(key, time).groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {time} double, allowed boolean", "start double, seen long", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, time: str, key: str, width: str, late: str) -> DataFrame:
    """Tumbling counts per key with a watermark; works on streams and tables."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"))


def replay(events: DataFrame, key: str, order: list[str], size: int = 100) -> DataFrame:
    """The last `size` events of each key, as a feed replays them to a late subscriber."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return events.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= size).drop("_rn")


def run_to_table(spark: SparkSession, stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and returns its rows; progress is kept in the checkpoint folder."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)
