"""Versioned tables: append-only rows with created and expired (null: live), and the operators over them.

As-of tests are half open: created <= t and (expired is null or expired > t).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .core import hinted

METADATA = ("key", "version", "created", "expired", "created_by", "change_type", "change_summary")
RETENTION_SECONDS = 7_776_000


def live(df: DataFrame) -> DataFrame:
    return df.where(F.col("expired").isNull())


def as_of(df: DataFrame, t: Column, **equal) -> DataFrame:
    """Rows that hold at t, with equality filters on any columns."""
    tests = [F.col("created") <= t, F.col("expired").isNull() | (F.col("expired") > t)] + [F.col(k) == v for k, v in equal.items()]
    return df.where(reduce(lambda a, b: a & b, tests))


def current(df: DataFrame, key, key_col: str = "key") -> DataFrame:
    """The live row of a key."""
    return live(df).where(F.col(key_col) == key).limit(1)


def history(df: DataFrame, key, identity: str = "uri") -> DataFrame:
    """All versions of the key's identity, newest first."""
    own = df.where(F.col("key") == key).select(identity).distinct()
    return df.join(hinted(own.limit(1)), identity, "left_semi").orderBy(F.col("created").desc(), F.col("version").desc())


def edge_history(edges: DataFrame, key) -> DataFrame:
    """All versions of the key's edge, by end points and ontology, newest first, with their number."""
    ends = ["src", "dst", "ontology_id"]
    own = edges.where(F.col("key") == key).select(*ends).limit(1)
    found = edges.join(hinted(own), ends, "left_semi")
    return found.withColumn("nth", F.row_number().over(Window.partitionBy(*ends).orderBy("created", "key")))


def expire(df: DataFrame, keys: DataFrame, now: float, retention: float = RETENTION_SECONDS) -> DataFrame:
    """df with the live rows of keys expired at now; ttl_expire_at is set unless retention is 0 or less."""
    hit = keys.select(F.col("key"), F.lit(True).alias("_hit")).distinct()
    own = F.col("_hit") & F.col("expired").isNull()
    ttl = F.when(own, F.lit(now + retention)) if retention > 0 else F.lit(None).cast("double")
    return df.join(hit, "key", "left").withColumn("ttl_expire_at", ttl).withColumn("expired", F.when(own, F.lit(now)).otherwise(F.col("expired"))).drop("_hit")


def collect_garbage(df: DataFrame, now: float, ttl: str = "ttl_expire_at") -> DataFrame:
    return df.where(F.col(ttl).isNull() | (F.col(ttl) > now))


def new_versions(df: DataFrame, changes: DataFrame, now: float, key_step: int) -> DataFrame:
    """df with each changed key's live row expired and a merged row appended: a new key, version + 1, created at now.

    changes: key and the columns that it sets (null: as before).
    """
    fields = [c for c in changes.columns if c != "key"]
    renamed = changes.select("key", *[F.col(c).alias(f"_new_{c}") for c in fields])
    fresh = live(df).join(renamed, "key").withColumns({c: F.coalesce(f"_new_{c}", c) for c in fields})
    fresh = fresh.withColumns({"key": F.col("key") + key_step, "version": F.col("version") + 1, "created": F.lit(now), "expired": F.lit(None).cast("double")})
    gone = df.join(changes.select("key", F.lit(True).alias("_hit")), "key", "left")
    gone = gone.withColumn("expired", F.when(F.col("_hit") & F.col("expired").isNull(), F.lit(now)).otherwise(F.col("expired")))
    return gone.select(*df.columns).unionByName(fresh.select(*df.columns))


def remap_edges(edges: DataFrame, mapping: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """edges with both ends replaced by mapping (old, new) where it has them; self loops move at both ends."""
    a = mapping.select(F.col("old").alias(src), F.col("new").alias("_a"))
    b = mapping.select(F.col("old").alias(dst), F.col("new").alias("_b"))
    moved = edges.join(a, src, "left").join(b, dst, "left")
    return moved.withColumn("moved", F.col("_a").isNotNull() | F.col("_b").isNotNull()).withColumns({src: F.coalesce("_a", src), dst: F.coalesce("_b", dst)}).drop("_a", "_b")


def insert_absent(edges: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """Those of more that have no live edge with the same keys."""
    return more.dropDuplicates(keys).join(live(edges), keys, "left_anti")


def expire_cascade(edges: DataFrame, keys: DataFrame) -> DataFrame:
    """Live edges at either end of the keys, each once."""
    a = keys.select(F.col("key").alias("src"), F.lit(True).alias("_a")).distinct()
    b = keys.select(F.col("key").alias("dst"), F.lit(True).alias("_b")).distinct()
    return live(edges).join(a, "src", "left").join(b, "dst", "left").where("_a OR _b").drop("_a", "_b")


def payload_hash(df: DataFrame, skip=METADATA) -> Column:
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in df.columns if c not in skip])), 256)


def diff(before: DataFrame, after: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """keys and change (added, removed, changed) between two tables with unique keys; nulls equal nulls."""
    packed = lambda df, name: df.select(*keys, F.struct(*fields).alias(name))
    both = packed(before, "_a").join(packed(after, "_b"), keys, "full_outer")
    same = F.col("_a").eqNullSafe(F.col("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~same, "changed")
    return both.select(*keys, change.alias("change")).where("change IS NOT NULL")


def temporal_diff(df: DataFrame, t1: Column, t2: Column, identity: str, fields: list[str]) -> DataFrame:
    return diff(as_of(df, t1), as_of(df, t2), [identity], fields)


def timeline(df: DataFrame, kind: str) -> DataFrame:
    """An event for each version: created for first ones, updated for later ones, and an expiry event at its own instant."""
    made = df.select("key", "uri", F.col("created").alias("at"), F.when(F.col("version") == 1, "created").otherwise("updated").alias("event"))
    gone = df.where("expired IS NOT NULL").select("key", "uri", F.col("expired").alias("at"), F.lit("expired").alias("event"))
    return made.unionByName(gone).withColumn("entity_type", F.lit(kind))


def revert(df: DataFrame, key, version_created: Column, now: float, key_step: int, tolerance: float = 0.001) -> DataFrame:
    """The payload that held when version_created began, as a new version (the row to append)."""
    own = df.where((F.col("key") == key) & (F.abs(F.col("created") - version_created) <= tolerance)).limit(1)
    return own.withColumns({"key": F.col("key") + key_step, "version": F.col("version") + 1, "created": F.lit(now), "expired": F.lit(None).cast("double")})


def snapshot_edges(edges: DataFrame, active: DataFrame, t: Column) -> DataFrame:
    """Edges as of t with both or either end among the active keys: either_end and both_ends tell which."""
    a = active.select(F.col("key").alias("src"), F.lit(True).alias("_a")).distinct()
    b = active.select(F.col("key").alias("dst"), F.lit(True).alias("_b")).distinct()
    out = as_of(edges, t).join(a, "src", "left").join(b, "dst", "left").where("_a OR _b")
    return out.withColumn("both_ends", F.coalesce("_a", F.lit(False)) & F.coalesce("_b", F.lit(False))).drop("_a", "_b")


def create(rows: DataFrame, now: float, created_by: str, change_type: str = "initial", change_summary: str = "") -> DataFrame:
    """rows as first versions: version 1, live from now on, with who made them and why; appended to a table, never written over."""
    stamped = {"version": F.lit(1).cast("long"), "created": F.lit(now), "expired": F.lit(None).cast("double")}
    return rows.withColumns(stamped | {"created_by": F.lit(created_by), "change_type": F.lit(change_type), "change_summary": F.lit(change_summary)})


#: Fields that say nothing about a row's schema.
SCHEMA_METADATA = ("key", "version", "created", "expired", "ttl_expire_at", "ontology_id", "source_run_id")


def schema_changed(before: DataFrame, after: DataFrame, identity: str = "uri") -> DataFrame:
    """identity and changed of rows in both tables: whether any field but the metadata differs, nulls being equal; a field that one table lacks is null there."""
    fields = sorted((set(before.columns) | set(after.columns)) - set(SCHEMA_METADATA) - {identity})
    packed = lambda df, name: df.where(F.coalesce(F.col(identity), F.lit("")) != "").select(identity, F.struct(*[(F.col(c) if c in df.columns else F.lit(None)).cast("string").alias(c) for c in fields]).alias(name))
    return packed(before, "_a").join(packed(after, "_b"), identity).select(identity, (~F.col("_a").eqNullSafe(F.col("_b"))).alias("changed"))


def as_of_join(points: DataFrame, versions: DataFrame, key: str, at: str, created: str = "created", expired: str = "expired") -> DataFrame:
    """points (key, at) with every other column of the version (key, created, expired) that holds at their instant; null if there is none.

    Both sides are sorted together within a key and the last version before a point is carried to it, so nothing is paired
    that doesn't match.  Of versions created at one instant the last in the order of their fields counts.
    """
    fields = [c for c in versions.columns if c != key]
    held = versions.select(F.col(key), F.col(created).alias("_at"), F.lit(0).alias("_turn"), F.struct(*fields).alias("_version"), F.lit(None).cast(points.select(F.struct("*")).schema[0].dataType).alias("_point"))
    asked = points.select(F.col(key), F.col(at).alias("_at"), F.lit(1).alias("_turn"), F.lit(None).cast(held.schema["_version"].dataType).alias("_version"), F.struct("*").alias("_point"))
    order = Window.partitionBy(key).orderBy("_at", "_turn", "_version").rowsBetween(Window.unboundedPreceding, 0)
    swept = held.unionByName(asked).withColumn("_version", F.last("_version", ignorenulls=True).over(order)).where("_turn = 1")
    fits = F.col(f"_version.{expired}").isNull() | (F.col(f"_version.{expired}") > F.col("_at"))
    return swept.select("_point.*", *[F.when(fits, F.col(f"_version.{c}")).alias(c) for c in fields if c not in points.columns])
