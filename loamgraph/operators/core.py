"""Checkpoints in the shared folder, checked broadcasts and running sums."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> None:
    """Use spark.checkpoint.dir of the session; where neither it nor the context has one, a local session gets a folder of its own and a cluster an error."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(given or os.path.join(tempfile.gettempdir(), "loamgraph-checkpoints"))


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own beside the checkpoints, which all executors share."""
    checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: its rows survive lost executors, and later jobs don't recompute its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, rows: int) -> bool:
    """Whether df (cheap to count: a checkpoint, an aggregate or a plain scan) has at most so many rows."""
    return df.limit(rows + 1).count() <= rows


def hinted(df: DataFrame, rows: int = 50_000) -> DataFrame:
    """df with a broadcast hint if its counted rows allow it; else the planner shuffles and AQE splits skewed keys."""
    return df.hint("broadcast") if small(df, rows) else df


def running(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """df with `step`, each row's place from 1, and running sums (new name: column) up to it: sorted by ranges, summed by range, so no task sees all rows."""
    ranged = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    value = lambda c: F.coalesce(F.col(c), F.lit(0))
    totals = ranged.groupBy("_part").agg(F.count("*").alias("_n"), *[F.sum(value(c)).alias(f"_{k}") for k, c in sums.items()])
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    none = F.lit(0)
    before = totals.select("_part", F.coalesce(F.sum("_n").over(ahead), none).alias("_n"), *[F.coalesce(F.sum(f"_{k}").over(ahead), none).alias(f"_{k}") for k in sums])
    inside = Window.partitionBy("_part").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(hinted(before), "_part").withColumn("step", F.row_number().over(inside) + F.col("_n"))
    return out.withColumns({k: F.sum(value(c)).over(upto) + F.col(f"_{k}") for k, c in sums.items()}).drop("_part", "_n", *[f"_{k}" for k in sums])
