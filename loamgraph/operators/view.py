"""A stored effective view that follows a feed of versions, and a cache of snapshots.

The view of an ontology holds the live rows of itself and of all it imports, each with its source, and the URIs that several
sources define.  A feed of changes is applied to the parts that it touches: rows by key, conflicts by URI; rows of ontologies
that come into the closure are read from the base table, those of ontologies that leave it are dropped.
"""

from __future__ import annotations

import hashlib
import time as clock
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import stored
from .core import cut, hinted, running
from .graph import closure

#: Seconds that a snapshot is good for.
TTL = 300.0


def folded(feed: DataFrame, key: str = "key", order: str = "seq") -> DataFrame:
    """The last change of each key."""
    return feed.groupBy(key).agg(F.max_by(F.struct(*[F.col(c) for c in feed.columns]), order).alias("_last")).select("_last.*")


def conflicts_of(rows: DataFrame) -> DataFrame:
    """uri, n and sources of the URIs that rows of several sources have."""
    return rows.groupBy("uri").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("source")).alias("sources")).where(F.size("sources") > 1)


def rebuilt(base: DataFrame, imports: DataFrame, root, max_depth: int = 10) -> DataFrame:
    """The view from nothing: live rows of base in the closure of root, with depth and is_imported."""
    sources = closure(imports, [root], max_depth).select(F.col("node").alias("source"), "depth")
    return base.where("expired IS NULL").join(hinted(sources), "source").withColumn("is_imported", F.col("depth") > 0)


class EffectiveView:
    """The view of one root in a folder: rows, conflicts, sources and progress.

    Base rows have key, uri, source and expired (null: live), and any further columns; changes have seq and the columns of a
    row, as it is from then on.  A change is applied once: those up to the last seq are passed over, so a feed may come again.
    """

    def __init__(self, spark: SparkSession, path: str, root, max_depth: int = 10):
        self.spark, self.path, self.root, self.max_depth = spark, path, root, max_depth

    def _table(self, name: str) -> DataFrame:
        return stored.read(self.spark, f"{self.path}/{name}")

    @property
    def seq(self) -> int:
        return self.spark.read.parquet(f"{self.path}/progress").agg(F.max("seq")).head()[0]

    @property
    def sources(self) -> DataFrame:
        return self._table("sources")

    @property
    def rows(self) -> DataFrame:
        return self._table("rows").join(hinted(self.sources), "source").withColumn("is_imported", F.col("depth") > 0)

    @property
    def conflicts(self) -> DataFrame:
        return self._table("conflicts")

    def _done(self, seq: int) -> None:
        self.spark.createDataFrame([(seq,)], "seq long").coalesce(1).write.mode("append").parquet(f"{self.path}/progress")

    def create(self, base: DataFrame, imports: DataFrame, seq: int = 0) -> None:
        sources = closure(imports, [self.root], self.max_depth).select(F.col("node").alias("source"), "depth")
        stored.write(sources, f"{self.path}/sources", "source")
        rows = cut(base.where("expired IS NULL").join(hinted(sources.select("source")), "source", "left_semi"))
        stored.write(rows, f"{self.path}/rows", "key")
        stored.write(conflicts_of(rows), f"{self.path}/conflicts", "uri")
        self._done(seq)

    def apply(self, feed: DataFrame, base: DataFrame | None = None, imports: DataFrame | None = None) -> dict[str, int]:
        """Takes a feed into the view; imports: the edges as they are now, if they changed (base: then the table, with the feed in it).

        Progress is written last and every step sets what it says, so after a failure the same call is made again.
        """
        last = self.seq
        new = cut(feed.where(F.col("seq") > last))
        change, before = cut(folded(new).drop("seq")), self._table("rows")
        sources, known = self.sources, self.sources.select("source")
        joined = dropped = None
        if imports is not None:
            sources = cut(closure(imports, [self.root], self.max_depth).select(F.col("node").alias("source"), "depth"))
            joined, dropped = cut(sources.select("source").subtract(known)), cut(known.subtract(sources.select("source")))
        live = change.where("expired IS NULL").join(hinted(sources.select("source")), "source", "left_semi")
        gone = before.join(hinted(change.select("key")), "key", "left_semi")
        if imports is not None:
            more = base.where("expired IS NULL").join(hinted(joined), "source", "left_semi").join(hinted(change.select("key")), "key", "left_anti")
            live = live.unionByName(more.select(*live.columns))
            gone = gone.unionByName(before.join(hinted(dropped), "source", "left_semi")).distinct()
        live, gone = cut(live.select(*before.columns)), cut(gone)
        touched = cut(live.select("key").unionByName(gone.select("key")).distinct())
        parts = stored.parts_of(touched, "key")
        if parts:
            rows = before.join(hinted(touched), "key", "left_anti").unionByName(live)
            stored.write(rows, f"{self.path}/rows", "key", parts)
        uris = cut(live.select("uri").unionByName(gone.select("uri")).distinct())
        parts = stored.parts_of(uris, "uri")
        if parts:
            again = conflicts_of(self._table("rows").join(hinted(uris), "uri", "left_semi"))
            stored.write(self.conflicts.join(hinted(uris), "uri", "left_anti").unionByName(again), f"{self.path}/conflicts", "uri", parts)
        if imports is not None:
            stored.write(sources, f"{self.path}/sources", "source")
        self._done(max(last, new.agg(F.max("seq")).head()[0] or 0))
        return {"changes": change.count(), "touched": touched.count(), "uris": uris.count()}


def etag(rows: DataFrame, *order: str, columns: list[str] | None = None) -> str:
    """A tag of a table's rows in any order of files and tasks: SHA-256 over digests of ranges of the sorted rows.

    Rows are hashed one by one, digests are summed by range as whole numbers with each row's place, so no task or driver
    holds the table.
    """
    names = columns or rows.columns
    text = lambda c: F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    digest = F.conv(F.substring(F.sha2(F.concat(*map(text, names)), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    placed = running(rows.withColumn("_digest", digest), [F.col(c) for c in (order or names)], {})
    total = placed.agg(F.count("*").alias("n"), F.sum("_digest").alias("s"), F.sum(F.pmod(F.col("_digest") * F.pmod("step", F.lit(1_000_003)), F.lit((1 << 61) - 1).cast("decimal(38,0)"))).alias("w")).head()
    return hashlib.sha256(f"{total.n}:{total.s}:{total.w}".encode()).hexdigest()[:32]


class SnapshotCache:
    """Snapshots in a folder, by ontology and time to the microsecond, for TTL seconds or until the ontology is written to."""

    def __init__(self, spark: SparkSession, path: str, ttl: float = TTL, now: Callable[[], float] = clock.time):
        self.spark, self.path, self.ttl, self.now = spark, path, ttl, now

    def _folder(self, ontology) -> str:
        return f"{self.path}/{hashlib.sha256(str(ontology).encode()).hexdigest()[:24]}"

    def _fresh(self, ontology, at: float) -> str | None:
        """The newest whole copy that is not too old; copies are named by the millisecond they were made at."""
        system, where = stored.files(self.spark, f"{self._folder(ontology)}/{key(ontology, at)}")
        if not system.exists(where):
            return None
        made = [(int(s.getPath().getName().split("-")[0]), s.getPath().toString()) for s in system.listStatus(where)]
        whole = [(t, p) for t, p in made if system.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{p}/_SUCCESS"))]
        newest = max(whole, default=None)
        return newest[1] if newest and self.now() - newest[0] / 1000 <= self.ttl else None

    def get(self, ontology, at: float, make: Callable[[], DataFrame]) -> DataFrame:
        """The snapshot of an ontology at a time: a copy, or what make gives, which is kept.  Two that make it at once keep a copy each."""
        found = self._fresh(ontology, at)
        if found is None:
            found = f"{self._folder(ontology)}/{key(ontology, at)}/{int(self.now() * 1000)}-{uuid.uuid4().hex}"
            make().write.parquet(found)
        return self.spark.read.parquet(found)

    def invalidate(self, ontology) -> int:
        """Drops all copies of an ontology, as after a write; how many there were."""
        system, where = stored.files(self.spark, self._folder(ontology))
        if not system.exists(where):
            return 0
        n = len(system.listStatus(where))
        system.delete(where, True)
        return n


def key(ontology, at: float) -> str:
    return hashlib.sha256(f"{ontology}:{at:.6f}".encode()).hexdigest()
