"""Projections, filters and joins over knowledge-graph tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .core import hinted

CLASS_SUMMARY = ("key", "uri", "label", "ontology_id", "status", "tier", "confidence", "version")
EDGE_SUMMARY = ("key", "src", "dst", "ontology_id", "edge_type", "confidence")


def project(df: DataFrame, columns) -> DataFrame:
    """An allow-list of columns; missing ones are null."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).alias(c) for c in columns])


def listing(df: DataFrame, label: str | None = None, equal: dict | None = None, at_least: dict | None = None) -> DataFrame:
    """Live rows by case-insensitive label, equalities and lower bounds."""
    out = df.where("expired IS NULL")
    if label:
        out = out.where(F.lower("label").contains(label.lower()))
    for k, v in (equal or {}).items():
        out = out.where(F.col(k) == v)
    for k, v in (at_least or {}).items():
        out = out.where(F.col(k) >= v)
    return out


def revisions(df: DataFrame, ontology_id, action: str | None = None, status: str | None = None, since: Column | None = None) -> DataFrame:
    out = df.where(F.col("ontology_id") == ontology_id)
    out = out.where(F.col("action") == action) if action else out
    out = out.where(F.col("status") == status) if status else out
    out = out.where(F.col("created") >= since) if since is not None else out
    return out.orderBy(F.col("created").desc(), F.col("key").desc())


def stale(df: DataFrame, ontology_id, before: float, limit: int | None = None) -> DataFrame:
    """Live classes of an ontology without evidence since `before`, oldest first."""
    at = F.coalesce("last_evidenced_at", "created")
    out = df.where((F.col("ontology_id") == ontology_id) & F.col("expired").isNull() & (at < before)).orderBy(at, "key")
    return out.limit(limit) if limit else out


def differs(a: Column, b: Column) -> Column:
    """Not equal, where null differs from every value."""
    return ~a.eqNullSafe(b)


def feedback(decisions: DataFrame, runs: DataFrame, limit: int) -> DataFrame:
    """Newest edits and rejections of the runs; the limit is held within 1..1000."""
    own = decisions.where(F.col("action").isin("edit", "reject")).join(hinted(runs), "run_id", "left_semi")
    return own.orderBy(F.col("created_at").desc(), F.col("key").desc()).limit(min(max(limit, 1), 1000))


def without_terms(df: DataFrame, column: str, terms: list[str]) -> DataFrame:
    return df.where(~F.lower(F.trim(column)).isin(*terms))


def without_weak_words(df: DataFrame, column: str, least: float = 0.5) -> DataFrame:
    return df.where(~((F.size(F.split(F.trim(column), r"\s+")) == 1) & (F.col("confidence") < least)))


def tenant(df: DataFrame, column: str, org: str, default: str = "default") -> DataFrame:
    """Rows of the organisation and of none; the default one sees everything."""
    return df if org == default else df.where(F.col(column).isNull() | (F.col(column) == org))


def grounded(provenance: Column) -> Column:
    return F.coalesce(F.exists(provenance, lambda p: p["char_span"].isNotNull()), F.lit(False))


def classify_documents(chunks: DataFrame, visual: Column, presentation: Column) -> DataFrame:
    """doc_id and kind of each document, from its chunks' texts, visual share and format.

    Visual-heavy documents come first (30 % visual chunks, or half of them slides, or some of both), then tables (over
    30 % of chunks with more than four bars), short technical texts, long ones (over 50 chunks), and the rest.
    """
    bars = F.length("text") - F.length(F.replace(F.col("text"), F.lit("|"), F.lit("")))
    share = lambda c: F.avg(c.cast("int"))
    own = chunks.groupBy("doc_id").agg(share(visual).alias("v"), share(presentation).alias("p"), share(bars > 4).alias("tables"), share(F.lower("text").rlike("specification|requirement|rfc|iso")).alias("technical"), F.count("*").alias("n"))
    heavy = (F.col("v") >= 0.3) | (F.col("p") >= 0.5) | ((F.col("v") > 0) & (F.col("p") > 0))
    technical = F.col("technical") > 0.2
    kind = F.when(heavy, "visual_heavy_presentation").when(F.col("tables") > 0.3, "tabular_structured").when((F.col("n") <= 10) & technical, "short_technical").when(F.col("n") > 50, "long_narrative").when(technical, "short_technical").otherwise("default")
    return own.select("doc_id", kind.alias("kind"))


def member_of(df: DataFrame, own: Column, others: DataFrame, key: str) -> DataFrame:
    """Rows with the property themselves or with a key among the others."""
    flagged = df.join(others.select(key).distinct().withColumn("_in", F.lit(True)), key, "left")
    return flagged.where(own | F.col("_in")).drop("_in")


def class_properties(domain: DataFrame, ranges: DataFrame) -> DataFrame:
    return domain.select("class_key", "prop").join(ranges.select("prop", F.col("class_key").alias("target")), "prop", "left").select("class_key", "prop", "target")


def domain_range(domain: DataFrame, ranges: DataFrame) -> DataFrame:
    """Class-to-class edges over a property: src, dst, prop."""
    return domain.select("prop", F.col("class_key").alias("src")).join(ranges.select("prop", F.col("class_key").alias("dst")), "prop")


def disjoint_violations(kids: DataFrame, disjoint: DataFrame) -> DataFrame:
    """Children of two parents that are declared disjoint: child, a, b."""
    x = kids.select("child", F.col("parent").alias("a"))
    y = kids.select("child", F.col("parent").alias("b"))
    return x.join(disjoint.select("a", "b").distinct(), "a").join(y, ["child", "b"]).select("child", "a", "b")


def conflicts(staging: DataFrame, domain: DataFrame, field: str) -> DataFrame:
    """Rows with one uri and different values: staging, domain, value, other; null differs from a value."""
    a = staging.select("uri", F.col("key").alias("staging"), F.col(field).alias("value"))
    b = domain.select("uri", F.col("key").alias("domain"), F.col(field).alias("other"))
    return a.join(b, "uri").where(differs(F.col("value"), F.col("other")))


def without_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no edge touches."""
    ends = edges.select(F.col("src").alias("node")).union(edges.select("dst"))
    return nodes.join(ends, "node", "left_anti")


def provenance(db_a: Column, db_b: Column, host_a: Column, host_b: Column) -> Column:
    return F.when((db_a == db_b) & (host_a == host_b), "same").when(db_a == db_b, "host_differs").otherwise("different")


PROFILES = ("summary", "full")


def profile(value: Column) -> Column:
    """Name of an include profile; null and unknown names mean full."""
    name = F.lower(F.trim(value))
    return F.when(name.isin(*PROFILES), name).otherwise("full")


def sort_field(name: str) -> str:
    """The name of a sort field, if it is a plain identifier."""
    if not isinstance(name, str) or not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
        raise ValueError(f"no such sort field: {name!r}")
    return name


def is_sort_field(name: Column) -> Column:
    return F.coalesce(name.rlike(r"\A[A-Za-z_][A-Za-z0-9_]*\z"), F.lit(False))


def signal_text(description: Column, evidence: Column) -> Column:
    """Description, evidence texts and their spans in order; evidence: array of structs text, spans."""
    parts = F.transform(evidence, lambda e: F.concat(F.array(e["text"]), F.coalesce(e["spans"], F.array().cast("array<string>"))))
    return F.array_join(F.filter(F.concat(F.array(description), F.coalesce(F.flatten(parts), F.array().cast("array<string>"))), lambda x: x.isNotNull()), " ")


def reasoning(uri_exact: Column, label_exact: Column, label_fuzzy: Column, overlap: Column, cosine: Column) -> Column:
    """Why a touchpoint matched: its signals above 0, joined."""
    two = lambda c: F.format_string("%.2f", c.cast("double"))
    parts = F.array(
        F.when(uri_exact > 0, "URI matches exactly"),
        F.when(label_exact > 0, "label matches exactly"),
        F.when((label_fuzzy > 0) & (label_fuzzy < 1), F.concat(F.lit("label fuzzy match ("), two(label_fuzzy), F.lit(")"))),
        F.when(overlap > 0, F.concat(F.lit("shared evidence chunks ("), two(overlap), F.lit(" Jaccard)"))),
        F.when(cosine > 0, F.concat(F.lit("embedding cosine "), two(cosine))),
    )
    text = F.array_join(F.filter(parts, lambda x: x.isNotNull()), "; ")
    return F.when(text == "", "no specific signals fired").otherwise(text)


def job_cursors(log: DataFrame) -> DataFrame:
    """job, stage and done of each job's last checkpoint (job, nth, stage, done), from which it goes on."""
    return log.groupBy("job").agg(F.max_by(F.struct("stage", "done"), "nth").alias("m")).select("job", "m.stage", "m.done")
