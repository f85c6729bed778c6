"""Guards, texts, gold sources, as-of and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relational as R
from ..operators import versioned as V
from ..operators.core import new_folder
from ..sources import rdf, schemas
from .registry import query


@query("SELECT key, label, CAST(1 AS BIGINT) AS version, CAST(1800000000 AS DOUBLE) AS created, CAST(NULL AS DOUBLE) AS expired, 'importer' AS created_by, 'initial' AS change_type FROM classes WHERE expired IS NULL")
def version_writer(t):
    rows = t.classes.where("expired IS NULL").select("key", "label")
    return V.create(rows, 1_800_000_000.0, "importer").select("key", "label", "version", "created", "expired", "created_by", "change_type")


@query("SELECT uri, key % 4 = 0 AS changed FROM classes")
def schema_change_predicate(t):
    """Every row has new metadata; every fourth has another label."""
    before = t.classes.select("uri", "key", "label", "description", "version", "created")
    after = before.select("uri", (F.col("key") + 1).alias("key"), F.when(F.col("key") % 4 == 0, F.concat("label", F.lit("!"))).otherwise(F.col("label")).alias("label"), "description", (F.col("version") + 1).alias("version"), F.lit(0.0).alias("created"))
    return V.schema_changed(before, after)


@query("""WITH v AS (SELECT uri AS user_id, key, version, created, expired FROM entity_versions WHERE key % 2 = 0), p AS (SELECT event_id, user_id, ts AS "at" FROM events)
SELECT p.event_id, CASE WHEN v.expired IS NULL OR v.expired > p."at" THEN v.version END AS version FROM p ASOF LEFT JOIN v ON v.user_id = p.user_id AND v.created <= p."at" """)
def as_of_join(t):
    """The version of an entity that holds when an event happens, if any does: every other version has been dropped."""
    versions = t.entity_versions.where("key % 2 = 0").select(F.col("uri").alias("user_id"), "key", "version", "created", "expired")
    points = t.events.select("event_id", "user_id", F.col("ts").alias("at"))
    return V.as_of_join(points, versions, "user_id", "at").select("event_id", "version")


@query("""SELECT key, CASE lower(trim(v)) WHEN 'summary' THEN 'summary' ELSE 'full' END AS profile FROM (SELECT key, CASE key % 4 WHEN 0 THEN ' Summary' WHEN 1 THEN 'full' WHEN 2 THEN 'everything' END AS v FROM classes)""")
def include_profile(t):
    m = F.col("key") % 4
    value = F.when(m == 0, " Summary").when(m == 1, "full").when(m == 2, "everything")
    return t.classes.select("key", R.profile(value).alias("profile"))


@query("SELECT name, regexp_full_match(name, '[A-Za-z_][A-Za-z0-9_]*') AS ok FROM (SELECT DISTINCT source AS name FROM documents WHERE source IS NOT NULL UNION SELECT DISTINCT label FROM classes UNION SELECT unnest(['created', '_key', '1st', 'a;b', 'a.b', '']))")
def sort_field_guard(t):
    odd = t.spark.createDataFrame([(x,) for x in ("created", "_key", "1st", "a;b", "a.b", "")], "name string")
    names = t.documents.where("source IS NOT NULL").select(F.col("source").alias("name")).union(t.classes.select("label")).union(odd).distinct()
    return names.select("name", R.is_sort_field(F.col("name")).alias("ok"))


@query("SELECT key, concat_ws(' ', CASE WHEN key % 3 > 0 THEN description END, label, uri, brand, CASE WHEN key % 2 = 0 THEN label END) AS text FROM classes")
def signal_text(t):
    none = F.lit(None).cast("string")
    evidence = F.array(F.struct(F.col("label").alias("text"), F.array("uri", "brand").alias("spans")), F.struct(F.when(F.col("key") % 2 == 0, F.col("label")).otherwise(none).alias("text"), F.lit(None).cast("array<string>").alias("spans")))
    return t.classes.select("key", R.signal_text(F.when(F.col("key") % 3 > 0, F.col("description")), evidence).alias("text"))


@query("""SELECT key, CASE WHEN r = '' THEN 'no specific signals fired' ELSE r END AS reasoning FROM (SELECT key, concat_ws('; ', CASE WHEN key % 7 = 0 THEN 'URI matches exactly' END, CASE WHEN key % 5 = 0 THEN 'label matches exactly' END,
CASE WHEN key % 4 BETWEEN 1 AND 3 AND (key % 4) / 3.0 < 1 THEN 'label fuzzy match (' || printf('%.2f', (key % 4) / 3.0) || ')' END, CASE WHEN key % 3 > 0 THEN 'shared evidence chunks (' || printf('%.2f', (key % 3) / 9.0) || ' Jaccard)' END, CASE WHEN key % 6 = 1 THEN 'embedding cosine 0.50' END) AS r FROM classes)""")
def touchpoint_reasoning(t):
    k = F.col("key")
    flag = lambda n: F.when(k % n == 0, 1.0).otherwise(0.0)
    text = R.reasoning(flag(7), flag(5), k % 4 / F.lit(3.0), k % 3 / F.lit(9.0), F.when(k % 6 == 1, 0.5))
    return t.classes.select("key", text.alias("reasoning"))


@query("SELECT user_id AS job, arg_max(event_type, event_id) AS stage, arg_max(value, event_id) AS done FROM events GROUP BY 1")
def resumable_cursor(t):
    return R.job_cursors(t.events.select(F.col("user_id").alias("job"), F.col("event_id").alias("nth"), F.col("event_type").alias("stage"), F.col("value").alias("done")))


@query("SELECT r_regionkey::VARCHAR AS doc_id, r_name AS head, 'holds' AS relation, n_name AS tail FROM region JOIN nation ON n_regionkey = r_regionkey")
def gold_corpus(t):
    """Gold documents in JSON lines, read back as triples; every document has an index that points nowhere."""
    own = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_regionkey", "r_name").agg(F.sort_array(F.collect_list("n_name")).alias("names"))
    triples = F.transform(F.sequence(F.lit(1), F.size("names") + 1), lambda i: F.struct(F.lit(0).alias("h"), F.lit("holds").alias("r"), i.alias("t")))
    docs = own.select(F.col("r_regionkey").cast("string").alias("doc_id"), F.concat(F.array("r_name"), "names").alias("vertices"), triples.alias("triples"))
    path = new_folder(t.spark, "gold")
    docs.write.json(path)
    return schemas.read_gold(t.spark, path)


@query("SELECT n_name AS name, 'urn:n#' || n_nationkey AS uri, r_name AS topic FROM nation JOIN region ON r_regionkey = n_regionkey")
def standard_catalog(t):
    """A catalogue in one JSON array, read back."""
    rows = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("name"), F.concat(F.lit("urn:n#"), F.col("n_nationkey").cast("string")).alias("uri"), F.col("r_name").alias("topic"))
    path = new_folder(t.spark, "catalog")
    rows.coalesce(1).agg(F.to_json(F.collect_list(F.struct("name", "uri", "topic"))).alias("value")).write.text(path)  # a catalogue is one small file
    return t.spark.read.schema("name string, uri string, topic string").json(path, multiLine=True)


@query("SELECT on_class, kind, value FROM (SELECT 'u:' || on_class AS on_class, unnest(['minCount', 'maxCount', 'pattern']) AS kind, unnest([min_count::VARCHAR, CASE WHEN on_class % 3 = 0 THEN 'many' ELSE max_count::VARCHAR END, 'a+']) AS value FROM constraints) WHERE kind = 'pattern' OR TRY_CAST(value AS INTEGER) IS NOT NULL")
def shacl_value_guard(t):
    """Shapes of constraints and back: counts that are no numbers are left out."""
    own = t.constraints.select(F.concat(F.lit("u:"), F.col("on_class").cast("string")).alias("on_class"), F.explode(F.array(F.struct(F.lit("minCount").alias("kind"), F.col("min_count").cast("string").alias("value")), F.struct(F.lit("maxCount").alias("kind"), F.when(F.col("on_class") % 3 == 0, "many").otherwise(F.col("max_count").cast("string")).alias("value")), F.struct(F.lit("pattern").alias("kind"), F.lit("a+").alias("value")))).alias("c"))
    rows = own.select("on_class", F.lit("u:lines").alias("property_uri"), "c.kind", "c.value")
    return rdf.shapes_of(rdf.shape_triples(rows)).select("on_class", "kind", "value")


@query("""WITH o AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '12 hours' THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM o)
SELECT user_id, min(ts) AS start, count(*) AS events FROM s GROUP BY user_id, n""")
def session_windows(t):
    """Events of a user with gaps under twelve hours are one session."""
    own = t.events.withColumn("ts", F.col("ts").cast("timestamp")).groupBy("user_id", F.session_window("ts", "12 hours").alias("w")).agg(F.count("*").alias("events"))
    return own.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "events")


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1")
def percentile_by_group(t):
    p = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY value)")
    return t.events.groupBy("event_type").agg(p(0.5).alias("p50"), p(0.95).alias("p95"))


@query("SELECT 'both' AS side, key FROM (SELECT l_partkey AS key FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A') UNION ALL SELECT 'left', key FROM (SELECT l_partkey AS key FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A')")
def set_operations(t):
    side = lambda f: t.lineitem.where(F.col("l_returnflag") == f).select(F.col("l_partkey").alias("key"))
    both, left = side("R").intersect(side("A")), side("R").subtract(side("A"))
    return both.select(F.lit("both").alias("side"), "key").unionByName(left.select(F.lit("left").alias("side"), "key"))
