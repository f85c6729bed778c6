"""Migrations of a folder of tables: ordered steps, a ledger, and tables that change at once or not at all.

A step reads tables and says what they become; each new table is written to a folder of its own, and the ledger's entry of the
step, written last, says which folders hold.  A step that fails leaves no entry, so the tables stay as they were, and the next
run begins with it again; a step with an entry is passed over.
"""

from __future__ import annotations

import hashlib
import json
import time as clock
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .stored import files

_LEDGER = "number int, name string, digest string, tables string, applied_at double"
Change = dict[str, DataFrame | None]


class Step(NamedTuple):
    """number orders the steps; change gets a reader of tables and gives those that are new or different (None: dropped).

    says: what the step does, in words; a step whose number, name or says differ from what was applied is an error.
    """

    number: int
    name: str
    change: Callable[[Callable[[str], DataFrame]], Change]
    says: str = ""

    @property
    def digest(self) -> str:
        return hashlib.sha256(json.dumps([self.number, self.name, self.says]).encode()).hexdigest()


class Migrator:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def ledger(self) -> list:
        """Entries by number: one for each step that was applied."""
        system, where = files(self.spark, f"{self.path}/_ledger")
        return self.spark.read.schema(_LEDGER).parquet(f"{self.path}/_ledger").orderBy("number", "applied_at").collect() if system.exists(where) else []

    def tables(self) -> dict[str, str]:
        """Folders of the tables as they are."""
        out: dict[str, str | None] = {}
        for entry in self.ledger():
            out |= json.loads(entry.tables)
        return {name: folder for name, folder in out.items() if folder}

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self.tables()[name]}")

    def apply(self, steps: list[Step]) -> list[str]:
        """Applies the steps that are not in the ledger, in order, and returns their names."""
        steps = sorted(steps, key=lambda s: s.number)
        if len({s.number for s in steps}) < len(steps):
            raise ValueError("two steps have one number")
        known, done = {e.number: e for e in self.ledger()}, []
        last = max(known, default=-1)
        for step in steps:
            if step.number in known:
                if known[step.number].digest != step.digest:
                    raise ValueError(f"step {step.number} was applied as {known[step.number].name!r} and differs now")
                continue
            if step.number < last:
                raise ValueError(f"step {step.number} comes before step {last}, which was applied")
            written = {}
            for name, df in step.change(self.read).items():
                written[name] = None if df is None else f"{name}/{step.number:04d}-{uuid.uuid4().hex}"
                if df is not None:
                    df.write.parquet(f"{self.path}/{written[name]}")
            entry = self.spark.createDataFrame([(step.number, step.name, step.digest, json.dumps(written), clock.time())], _LEDGER)
            entry.coalesce(1).write.mode("append").parquet(f"{self.path}/_ledger")
            done.append(step.name)
        return done

    def sweep(self) -> int:
        """Removes folders that no table has any more, or that a failed step left; how many there were."""
        held, gone = set(self.tables().values()), 0
        system, where = files(self.spark, self.path)
        for table in system.listStatus(where):
            name = table.getPath().getName()
            if table.isDirectory() and not name.startswith("_"):
                for folder in system.listStatus(table.getPath()):
                    if f"{name}/{folder.getPath().getName()}" not in held:
                        system.delete(folder.getPath(), True)
                        gone += 1
        return gone


def add_column(number: int, table: str, column: str, value: Column | Callable[[], Column]) -> Step:
    """A column with a value for the rows there are; the value may be given as a function, to be made when a session is there."""
    own = lambda read: {table: read(table).withColumn(column, value if isinstance(value, Column) else value())}
    return Step(number, f"add_{table}_{column}", own, f"add {column}")


def rename_column(number: int, table: str, before: str, after: str) -> Step:
    return Step(number, f"rename_{table}_{before}", lambda read: {table: read(table).withColumnRenamed(before, after)}, f"{before} to {after}")


def backfill(number: int, table: str, column: str, expression: str) -> Step:
    """Nulls of a column take the value of an SQL expression over the row."""
    return Step(number, f"backfill_{table}_{column}", lambda read: {table: read(table).withColumn(column, F.coalesce(column, F.expr(expression)))}, expression)


def drop_table(number: int, table: str) -> Step:
    return Step(number, f"drop_{table}", lambda read: {table: None}, "drop")
