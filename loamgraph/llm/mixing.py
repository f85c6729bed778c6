"""Mixing sources to target weights.

Sources in code point order, null last, take the weights in turn and share `share` of all sizes.  A source's target stops
at `most` times its size; the excess is shared again by weight until no target is above.  A source's repetition rate is
target / size; each document comes floor(rate) times, plus once more if its seeded hash falls below the rate's fraction.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, hinted

WEIGHTS = (5, 2, 1)
SHARE = Fraction(3, 2)
MOST = 2
SEED = "mix-1"

_BLANK = "\\x20\\x09-\\x0D"


def n_words(text: Column) -> Column:
    """Words of a text as a long; 0 for null."""
    inner = F.regexp_replace(text, f"^[{_BLANK}]+|[{_BLANK}]+$", "")
    return F.when(F.coalesce(F.length(inner), F.lit(0)) == 0, F.lit(0)).otherwise(F.size(F.split(inner, f"[{_BLANK}]+"))).cast("long")


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """df (checkpointed) with the row's place, from 0, as `place`: sorted by ranges, counted by range, so no task sees all rows."""
    ranged = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    inner = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return cut(ranged.withColumn("_inner", inner).join(hinted(before), "_part").withColumn("place", F.col("_before") + F.col("_inner")).drop("_part", "_inner", "_before"))


def targets(sources: DataFrame, source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, most: int = MOST) -> DataFrame:
    """sources (source, source_size) with weight, target and rate (null for a source without words).

    The level, target per weight, is found by Newton steps: each one is an aggregate over the sources, and it ends when
    no further source reaches its limit.  All comparisons are between integers.
    """
    placed = numbered(sources, F.col(source_col).asc_nulls_last())
    pick = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    placed = placed.select(source_col, "source_size", pick.cast("long").alias("weight"))
    big = lambda c: c.cast("decimal(38,0)")
    total, rest = (x or 0 for x in placed.agg(F.sum("source_size"), F.sum("weight")).head())
    p, q = share.numerator, share.denominator
    capped_size = 0
    while True:
        # level = (p/q * total - most * capped) / rest weights; a source is capped if weight * level >= most * size
        top, under = p * total - q * most * capped_size, q * rest
        capped = big(F.col("weight")) * F.lit(top).cast("decimal(38,0)") >= big(F.col("source_size")) * F.lit(most * under).cast("decimal(38,0)")
        row = placed.agg(F.sum(F.when(capped, F.col("source_size")).otherwise(0)), F.sum(F.when(capped, 0).otherwise(F.col("weight")))).head()
        if (row[1] or 0) == rest:
            break
        capped_size, rest = row
        if not rest:
            top, under = 0, 1
            capped = F.lit(True)
            break
    target = F.when(capped, (F.col("source_size") * most).cast("double")).otherwise((F.col("weight") * F.lit(top)).cast("double") / F.lit(float(under)))
    rate = F.when(F.col("source_size") > 0, target / F.col("source_size").cast("double"))
    return placed.withColumn("target", target).withColumn("rate", rate)


def nameless(id_col: str, text_col: str) -> Column:
    """What stands for the id of a row without one: the hash of its text; null for the others."""
    return F.when(F.col(id_col).isNull(), F.md5(F.coalesce(F.col(text_col), F.lit("")))).alias("_nameless")


def coin(id_col: str, seed: str = SEED) -> Column:
    """A number in [0, 1) from 52 bits of the hash of seed and id, or what stands for it as _nameless."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.col("_nameless")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def with_copies(rows: DataFrame, rates: DataFrame, id_col: str = "doc_id", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """rows (with _nameless) with source_size, target and copies.  The sources are broadcast if they are few, else AQE splits hot ones."""
    own = rates.select(F.col(source_col).alias("_source"), "source_size", "target", "rate")
    joined = rows.join(hinted(own), F.col(source_col).eqNullSafe(F.col("_source")), "left").drop("_source")
    rate = F.coalesce(F.col("rate"), F.lit(0.0))
    whole = F.floor(rate)
    return joined.withColumn("copies", whole + (coin(id_col, seed) < rate - whole).cast("long")).drop("rate", "_nameless")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """Per row: size, source_size, target (of its source) and taken (words the mix takes of it).

    Null texts have size 0, null is a source of its own; rows of one id share their hash, so repeated rows are taken alike,
    and rows without id are told apart by their texts; an empty table gives no rows.  Only ids, sources and sizes are shuffled; other columns of docs don't matter.
    """
    rows = cut(docs.select(F.col(id_col), F.col(source_col), nameless(id_col, text_col), n_words(F.col(text_col)).alias("size")))
    rates = targets(rows.groupBy(source_col).agg(F.sum("size").alias("source_size")), source_col)
    out = with_copies(rows, rates, id_col, source_col, seed)
    return out.select(id_col, "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """The documents themselves, each as many times as the mix takes it, with all columns of docs."""
    names = docs.columns
    rates = targets(docs.groupBy(source_col).agg(F.sum(n_words(F.col(text_col))).alias("source_size")), source_col)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(id_col), F.col(source_col), nameless(id_col, text_col))
    out = with_copies(whole, rates, id_col, source_col, seed)
    return out.where("copies > 0").select("_row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("_row.*")


ORACLE = f"""
WITH d AS (SELECT doc_id, source, coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) AS name, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::HUGEINT AS source_size FROM d GROUP BY source),
p AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS k FROM s),
w AS (SELECT source, source_size, CASE k WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::HUGEINT AS weight FROM p),
o AS (SELECT *, sum(source_size) OVER () AS total,
        sum(source_size) OVER (ORDER BY source_size::DOUBLE / weight, source ROWS UNBOUNDED PRECEDING) - source_size AS before,
        sum(weight) OVER (ORDER BY source_size::DOUBLE / weight DESC, source DESC ROWS UNBOUNDED PRECEDING) AS rest FROM w),
c AS (SELECT *, (3 * total - 4 * before) * weight >= 4 * source_size * rest AS capped FROM o),
l AS (SELECT coalesce(sum(source_size) FILTER (capped), 0) AS gone, sum(weight) FILTER (NOT capped) AS open FROM c),
t AS (SELECT source, source_size, CASE WHEN capped THEN (2 * source_size)::DOUBLE
        ELSE ((3 * total - 4 * gone) * weight)::DOUBLE / (2 * open)::DOUBLE END AS target FROM c, l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0 END AS rate FROM t)
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
  ((floor(rate) + CASE WHEN ('0x' || substr(md5('{SEED}:' || name), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 < rate - floor(rate) THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
"""
