"""Graph tables derived from the Parquet tables, as SQL that Spark and DuckDB both read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: name: SQL; {name} stands for another table.
DERIVED = {
    "entity_versions": """SELECT event_id AS key, user_id AS uri, user_id % 3 AS ontology_id, event_type, value, ts AS created,
        lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS expired,
        CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS version FROM {events}""",
    "classes": """SELECT p_partkey AS key, 'urn:part#' || CAST(p_partkey AS STRING) AS uri, p_name AS label, p_brand || ' ' || p_type AS description,
        p_partkey % 3 AS ontology_id, CASE p_partkey % 4 WHEN 0 THEN 'approved' WHEN 1 THEN 'pending' WHEN 2 THEN 'rejected' END AS status,
        CASE WHEN p_partkey % 2 = 0 THEN 'domain' ELSE 'local' END AS tier, CAST(p_size AS DOUBLE) / CAST(50 AS DOUBLE) AS confidence,
        CAST(1700000000 + p_partkey * 1000 AS DOUBLE) AS created,
        CASE WHEN p_partkey % 10 = 0 THEN CAST(1700500000 + p_partkey * 1000 AS DOUBLE) END AS expired,
        CASE WHEN p_partkey % 7 = 0 THEN CAST(1700200000 + p_partkey * 1000 AS DOUBLE) END AS last_evidenced_at,
        CAST(1 AS BIGINT) AS version, p_brand AS brand, p_type AS kind, p_size AS size FROM {part}""",
    "subclass_edges": """SELECT 'o' || CAST(o_orderkey AS STRING) AS src, 'c' || CAST(o_custkey AS STRING) AS dst FROM {orders}
        UNION ALL SELECT 'c' || CAST(c_custkey AS STRING), 'n' || CAST(c_nationkey AS STRING) FROM {customer}
        UNION ALL SELECT 'n' || CAST(n_nationkey AS STRING), 'r' || CAST(n_regionkey AS STRING) FROM {nation}""",
    "imports_edges": """SELECT CAST(n_nationkey AS BIGINT) AS src, CAST(floor(n_nationkey / 2.0) AS BIGINT) AS dst FROM {nation} WHERE n_nationkey > 0""",
    "cyclic_edges": """SELECT src, dst FROM {imports_edges} UNION ALL SELECT CAST(0 AS BIGINT), CAST(12 AS BIGINT)""",
    "relation_edges": """SELECT l_orderkey * 10 + l_linenumber AS key, l_orderkey AS src, l_partkey AS dst, l_suppkey % 5 AS ontology_id,
        l_shipdate AS created, CASE WHEN l_returnflag = 'R' THEN l_shipdate END AS expired, l_linestatus AS edge_type, l_quantity AS quantity,
        CASE WHEN l_quantity > 25 THEN l_quantity / 50 END AS confidence FROM {lineitem}""",
    "property_domain": "SELECT l_orderkey * 10 + l_linenumber AS prop, l_suppkey AS class_key FROM {lineitem} WHERE l_linenumber <= 2",
    "property_range": "SELECT l_orderkey * 10 + l_linenumber AS prop, l_partkey AS class_key FROM {lineitem} WHERE l_quantity > 10 AND l_linenumber <= 2",
    "passes": "SELECT l_partkey AS uri, CAST(l_linenumber AS BIGINT) AS pass, l_suppkey AS attr, l_quantity AS weight FROM {lineitem} WHERE l_linenumber <= 3",
    "decisions": """SELECT l.doc_id AS key, CASE WHEN l.toxic = 1 THEN 'reject' WHEN l.quality = 1 THEN 'approve' ELSE 'edit' END AS action,
        CAST(least(d.n_chars, 5000) AS DOUBLE) / CAST(5000 AS DOUBLE) AS confidence, d.lang AS run_id, d.source AS ontology_id,
        CAST(l.doc_id * 60 AS DOUBLE) AS created_at FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id""",
    "predicted": "SELECT DISTINCT l_partkey AS item, l_suppkey % 10 AS doc FROM {lineitem} WHERE l_quantity > 45 AND l_returnflag = 'R'",
    "gold": "SELECT DISTINCT l_partkey AS item, l_suppkey % 10 AS doc FROM {lineitem} WHERE l_quantity > 45 AND l_returnflag = 'A'",
    "entities": """SELECT min(key) AS key, ontology_id, label, min(description) AS description, count(*) AS n_rows, min(kind) AS kind, max(confidence) AS confidence
        FROM {classes} GROUP BY ontology_id, label""",
    "chunks": "SELECT conv_id AS doc_id, turn AS chunk_index, role, text FROM {conversations}",
    "revisions": """SELECT event_id AS key, user_id AS entity, event_type AS verdict, CASE WHEN value > 100 THEN 'REVISE' WHEN value > 50 THEN 'REINFORCE' ELSE 'FLAG_FOR_CURATION' END AS action,
        CASE WHEN event_id % 3 = 0 THEN 'pending' WHEN event_id % 3 = 1 THEN 'applied' ELSE 'failed' END AS status, user_id % 3 AS ontology_id, value, ts AS created FROM {events}""",
    "constraints": """SELECT s_suppkey AS on_class, 'lines' AS property_uri, CAST(400 + s_suppkey % 300 AS BIGINT) AS min_count, CAST(600 + s_suppkey % 50 AS BIGINT) AS max_count FROM {supplier}""",
}

_REF = re.compile(r"\{(\w+)\}")


class Tables:
    """Tables of a folder as attributes, base and derived."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._known = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._known:
            if name in DERIVED:
                refs = set(_REF.findall(DERIVED[name]))
                self._known[name] = self.spark.sql(DERIVED[name], **{r: getattr(self, r) for r in refs})
            elif name in BASE:
                self._known[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                raise AttributeError(name)
        return self._known[name]


def with_tables(sql: str) -> str:
    """DuckDB SQL with the derived tables that it names, before it."""
    words = set(re.findall(r"\w+", sql))
    wanted: list[str] = []

    def add(name: str) -> None:
        for r in _REF.findall(DERIVED[name]):
            if r in DERIVED:
                add(r)
        if name not in wanted:
            wanted.append(name)

    for name in DERIVED:
        if name in words:
            add(name)
    if not wanted:
        return sql
    ctes = ",\n".join(f"{n} AS ({_REF.sub(lambda m: m[1], DERIVED[n])})" for n in wanted)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes},\n{body[14:].strip()}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:].strip()}"
    return f"WITH {ctes}\n{body}"
