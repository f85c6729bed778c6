"""URL filters by sort-merge range joins, in DataFrame operations only.

A host's labels in reverse, each with a dot after it, make its key, so all subdomains of a rule's host lie in one interval
of keys; a rule host's key and a path make the key of a rule, so all paths that start with the rule's lie in one interval.
Intervals nest.  Points and interval ends are sorted together by ranges of keys; an end carries what is active after it, and
each point takes what the last end before it carries, across range borders too.  The first sweep gives each host the rule
hosts that hold it, the second gives each of these with the url's path the innermost rule, whose end has the rule around it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, hinted

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^(.*?)://([^/?#]*)([^?#]*)"


def after(at: Column) -> Column:
    """Sorts after every UTF-8 text that begins so."""
    return F.concat(at, F.expr("X'FF'"))


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 2), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 3), F.lit(""))


def key(host: Column) -> Column:
    """www.example.com: com.example.www. ; an empty host has an empty key, which no rule covers."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def prefixes(host_key: Column) -> Column:
    """The keys of the hosts that a host lies in, itself included; a key per label."""
    labels = F.split(F.regexp_replace(host_key, r"\.$", ""), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.array_join(F.slice(labels, 1, i), "."), F.lit(".")))


def sweep(points: DataFrame, ends: DataFrame) -> DataFrame:
    """points (at, binary) with held: that of the last end (at, held) at or before each point, null if there is none."""
    kind = ends.schema["held"].dataType
    events = points.withColumns({"kind": F.lit(1), "held": F.lit(None).cast(kind)}).unionByName(ends.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    ranged = cut(events.repartitionByRange("at", "kind").withColumn("part", F.spark_partition_id()))
    # what holds where a range begins: the last end of an earlier one; a row for each range
    last = ranged.groupBy("part").agg(F.max_by("held", F.when(F.col("kind") == 0, F.col("at"))).alias("own"))
    carried = last.select("part", F.last("own", ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    order = Window.partitionBy("part").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = ranged.join(hinted(carried), "part").withColumn("held", F.coalesce(F.last("held", ignorenulls=True).over(order), F.col("carried")))
    return swept.where("kind = 1").select(*points.columns, "held")


def host_ends(rule_hosts: DataFrame) -> DataFrame:
    """Both ends of every rule host's interval, with the rule hosts (host_key, longest: its longest path) that hold from there on, outermost first.

    rule_hosts: host_key, longest.
    """
    over = rule_hosts.select("host_key", F.explode(prefixes(F.col("host_key"))).alias("over"))
    around = over.join(rule_hosts.select(F.col("host_key").alias("over"), "longest"), "over")
    chain = around.groupBy("host_key").agg(F.array_sort(F.collect_list(F.struct(F.length("over").alias("depth"), F.col("over").alias("host_key"), "longest"))).alias("held"))
    start = chain.select(F.encode("host_key", "UTF-8").alias("at"), "held")
    end = chain.select(after(F.encode("host_key", "UTF-8")).alias("at"), F.expr("slice(held, 1, size(held) - 1)").alias("held"))
    return start.unionByName(end)


def rule_ends(rules: DataFrame) -> DataFrame:
    """Both ends of every rule's interval with the innermost rule (size, host_size, rule, verdict) from there on.

    rules: host_key, host, path, verdict, a row for each host and path.
    """
    own = rules.select("host_key", "path", F.struct((F.length("host") + F.length("path")).alias("size"), F.length("host").alias("host_size"), F.concat("host", "path").alias("rule"), "verdict").alias("held"))
    shorter = own.where("path <> ''").select("host_key", "path", F.explode(F.sequence(F.lit(0), F.length("path") - 1)).alias("n")).select("host_key", "path", F.expr("left(path, n)").alias("around"))
    outer = shorter.join(own.select("host_key", F.col("path").alias("around"), F.col("held").alias("outer")), ["host_key", "around"]).groupBy("host_key", "path").agg(F.max_by("outer", F.length("around")).alias("outer"))
    at = F.encode(F.concat("host_key", "path"), "UTF-8")
    none = F.expr("named_struct('size', 0, 'host_size', 0, 'rule', CAST(NULL AS STRING), 'verdict', CAST(NULL AS STRING))")
    end = own.join(outer, ["host_key", "path"], "left").select(after(at).alias("at"), F.coalesce("outer", none).alias("held"))
    return own.select(at.alias("at"), "held").unionByName(end)


def url_filter(pages: DataFrame, rules: DataFrame, otherwise: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: host, path, rule (null if none fits) and verdict (the rule's, else `otherwise`).

    rules: host, path, verdict.  A rule fits its host and all subdomains, if the url's path starts with the rule's path;
    the longest host and path win, of equally long ones the longer host.  Of rules with one host and path the greatest
    verdict counts.  Null urls and urls without :// have an empty host and path, and no rule.  Repeated rows give repeated
    results.  Hosts, and hosts with as much of the path as their rules look at, are made distinct before they are sorted, so
    a hot host or url is one row there; pages meet the results by host, and by host and start of the path.
    """
    rules = cut(rules.where("host <> ''").groupBy("host", "path").agg(F.max("verdict").alias("verdict")).withColumn("host_key", key(F.col("host"))))
    named = pages.select(F.col(id_col), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    named = named.withColumn("host_key", key(F.col("host")))
    hosts = named.where("host <> ''").select("host_key").distinct().withColumn("at", F.encode("host_key", "UTF-8"))
    swept = sweep(hosts, host_ends(rules.groupBy("host_key").agg(F.max(F.length("path")).alias("longest"))))
    held = cut(swept.where("size(held) > 0").select("host_key", "held", F.array_max(F.transform("held", lambda x: x["longest"])).alias("longest")))
    met = named.join(hinted(held), "host_key", "left").withColumn("start", F.expr("left(path, coalesce(longest, 0))"))
    points = met.where("held IS NOT NULL").select("host_key", "start", "held").dropDuplicates(["host_key", "start"])
    points = points.select("host_key", "start", F.explode("held").alias("over")).select("host_key", "start", F.encode(F.concat("over.host_key", "start"), "UTF-8").alias("at"))
    best = sweep(points, rule_ends(rules)).where("held.rule IS NOT NULL").groupBy("host_key", "start").agg(F.max("held").alias("best"))
    joined = met.drop("held").join(hinted(cut(best)), ["host_key", "start"], "left")
    return joined.select(id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), F.lit(otherwise)).alias("verdict"))


ORACLE = r"""
WITH u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^(.*?)://([^/?#]*)([^?#]*)', 2), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '(?s)^(.*?)://([^/?#]*)([^?#]*)', 3), '') AS path FROM pages),
r(host, path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
j AS (SELECT u.page_id, u.host, u.path, r.host || r.path AS rule, r.verdict,
  row_number() OVER (PARTITION BY u.page_id, u.host, u.path ORDER BY length(r.host) + length(r.path) DESC, length(r.host) DESC) AS k
  FROM (SELECT DISTINCT * FROM u) u JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path))
SELECT u.page_id, u.host, u.path, j.rule, coalesce(j.verdict, 'allow') AS verdict
FROM u LEFT JOIN j ON j.k = 1 AND u.page_id = j.page_id AND u.host = j.host AND u.path = j.path
"""
