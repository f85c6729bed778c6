"""Tables in a folder, dealt into parts by the hash of a key, of which a change rewrites only those it touches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .core import cut

#: Parts of a table; more only make more files.
PARTS = 64


def files(spark: SparkSession, path: str):
    """The file system of a path, and the path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def dealt(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn("part", F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(PARTS)).cast("int"))


def parts_of(keys: DataFrame, key: str) -> list[int]:
    """Parts that hold the keys: PARTS numbers at most."""
    return sorted(r[0] for r in dealt(keys.select(key), key).select("part").distinct().collect())


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("part")


def write(df: DataFrame, path: str, key: str, parts: list[int] | None = None) -> None:
    """Writes df to path: all of it, or the given parts only; df may be made from what is there."""
    spark, rows = df.sparkSession, dealt(df, key)
    if parts is not None:
        rows = cut(rows.where(F.col("part").isin(parts)))  # read before its folder is written
        empty = sorted(set(parts) - {r[0] for r in rows.select("part").distinct().collect()})
    spread = rows.repartition("part", F.pmod(F.xxhash64(F.lit(7), key), F.lit(8)))
    spread.write.mode("overwrite").option("partitionOverwriteMode", "static" if parts is None else "dynamic").partitionBy("part").parquet(path)
    system, where = files(spark, path)
    if parts is not None:
        for part in empty:
            system.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/part={part}"), True)
    if not any(s.getPath().getName().startswith("part=") for s in system.listStatus(where)):
        rows.drop("part").limit(0).withColumn("part", F.lit(0)).write.mode("overwrite").parquet(path)  # keeps the columns
