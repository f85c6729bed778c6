"""Extraction results to vertex and edge tables, the links between them, and their confidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as X

# fixed values: beginnings of lines that stand for pictures, and of lines that are no body text
VISUAL_BODY = ("[Visual omitted:", "[Visual (alt text):", "[Visual (caption):", "[Scanned")
VISUAL_MARKER = (*VISUAL_BODY, "[Slide ", "[Page ")


def fragment(uri: Column) -> Column:
    """What follows the last # and then the last / of a URI."""
    return F.substring_index(F.substring_index(uri, "#", -1), "/", -1)


def property_key(owner: Column, label: Column) -> Column:
    return F.concat(owner, F.lit("_"), F.lower(F.replace(label, F.lit(" "), F.lit("_"))))


def named_labels(texts: DataFrame, classes: DataFrame) -> DataFrame:
    """text, n (minus the label's length) and keys (its two smallest) for every distinct label that a text names; texts: text, distinct and in lower case."""
    edge = lambda c: F.concat(F.lit(" "), F.regexp_replace(c, r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    known = classes.select("key", F.lower(F.trim("label")).alias("name")).where("length(name) > 2 AND key IS NOT NULL").distinct()
    least = known.withColumn("_r", F.row_number().over(Window.partitionBy("name").orderBy("key"))).where("_r <= 2").groupBy("name").agg(F.array_sort(F.collect_list("key")).alias("keys"))
    labels = least.select((-F.length("name")).alias("n"), "keys", F.split("name", r"[^\p{L}\p{N}]+")[0].alias("first"), edge(F.col("name")).alias("_name"))
    words = texts.select("text", edge(F.col("text")).alias("_text"), F.explode(F.array_distinct(F.split("text", r"[^\p{L}\p{N}]+"))).alias("first")).where("first <> ''")
    return words.join(labels, "first").where(F.contains("_text", "_name")).select("text", "n", "keys")


def resolve_targets(links: DataFrame, classes: DataFrame) -> DataFrame:
    """links (id, owner, target, text) with class_key and tier: uri, fragment, label, text or miss; the first tier that fits counts.

    classes: key, uri, label.  A target may be a class's URI, its last part, or a label in lower case.  Other links are
    recovered by the longest label that their text names, of equals the smallest key, other than the owner's: words of the
    text are joined with the first words of labels, so no text meets every label.  Equal texts and equal labels meet once:
    an owner rules out one key, so a label's two smallest keys and a text's two best are enough.
    """
    best = lambda on, name: classes.select(on.alias("_t"), "key").where("_t <> ''").groupBy("_t").agg(F.min("key").alias(name))
    own = links.withColumns({"_u": F.col("target"), "_f": fragment(F.col("target")), "_l": F.lower(F.trim("target"))})
    for column, on, name in (("_u", F.col("uri"), "by_uri"), ("_f", fragment(F.col("uri")), "by_fragment"), ("_l", F.lower("label"), "by_label")):
        own = own.join(best(on, name).withColumnRenamed("_t", column), column, "left")
    texts = own.where("coalesce(by_uri, by_fragment, by_label) IS NULL AND text IS NOT NULL").select(F.lower("text").alias("text")).distinct()
    hits = named_labels(texts, classes).select("text", "n", F.explode("keys").alias("key")).groupBy("text", "key").agg(F.min("n").alias("n"))
    two = hits.withColumn("_r", F.row_number().over(Window.partitionBy("text").orderBy("n", "key"))).where("_r <= 2")
    named = two.groupBy(F.col("text").alias("_t")).agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("_m"))
    out = own.join(named, F.lower("text") == F.col("_t"), "left").withColumn("by_text", F.get(F.filter("_m", lambda x: x["key"] != F.col("owner")), F.lit(0))["key"])
    tier = F.when(F.col("by_uri").isNotNull(), "uri").when(F.col("by_fragment").isNotNull(), "fragment").when(F.col("by_label").isNotNull(), "label").when(F.col("by_text").isNotNull(), "text").otherwise("miss")
    return out.select(*links.columns, F.coalesce("by_uri", "by_fragment", "by_label", "by_text").alias("class_key"), tier.alias("tier"))


def materialise(results: DataFrame, now: float) -> dict[str, DataFrame]:
    """Vertex and edge tables of nested results, by name.

    results: doc_id, run_id, ontology_id, uri, label, description, parent_uri, attributes (array of label, range), relationships
    (array of label, target, text).  A class that several results name is one vertex, from the result with the greatest
    doc_id; its edges are those of all results, each once.  Parents that are the class itself or unknown make no edge; a
    relationship's property is kept with its target even where that resolves to no class.
    """
    own = results.withColumn("key", fragment(F.col("uri")))
    times = [F.lit(now).alias("created"), F.lit(None).cast("double").alias("expired")]
    latest = own.groupBy("key").agg(F.max_by(F.struct("uri", "label", "description", "ontology_id", "run_id"), F.struct("doc_id", "run_id")).alias("m")).select("key", "m.*")
    classes = latest.select("*", *times)
    attributes = own.select("doc_id", "key", "ontology_id", F.explode("attributes").alias("a")).select("doc_id", "key", "ontology_id", property_key(F.col("key"), F.col("a.label")).alias("prop"), F.col("a.label").alias("label"), F.col("a.range").alias("range"))
    relations = own.select("doc_id", "key", "ontology_id", F.explode("relationships").alias("a")).select("doc_id", "key", "ontology_id", property_key(F.col("key"), F.col("a.label")).alias("prop"), F.col("a.label").alias("label"), F.col("a.target").alias("target"), F.col("a.text").alias("text"))
    one = lambda df, *columns: df.groupBy(F.col("prop").alias("key")).agg(F.max_by(F.struct("label", "ontology_id", *columns), F.struct("doc_id", *columns)).alias("m")).select("key", "m.*", *times)
    known = classes.select("key", "uri", "label")
    wanted = relations.select(F.col("prop").alias("id"), F.col("key").alias("owner"), "target", "text", "ontology_id").dropDuplicates(["id", "target"])
    resolved = resolve_targets(wanted, known)
    parents = own.where("parent_uri IS NOT NULL").select(F.col("key").alias("id"), F.col("key").alias("owner"), F.col("parent_uri").alias("target"), F.lit(None).cast("string").alias("text"), "ontology_id").distinct()
    above = resolve_targets(parents, known).where("class_key IS NOT NULL AND class_key <> owner")
    edge = lambda df, src, dst: df.select(F.col(src).alias("src"), F.col(dst).alias("dst"), "ontology_id").distinct().select("*", *times)
    return {
        "classes": classes,
        "datatype_properties": one(attributes, "range"),
        "object_properties": one(relations, "target"),
        "rdfs_domain": edge(attributes.select("prop", "key", "ontology_id").unionByName(relations.select("prop", "key", "ontology_id")), "prop", "key"),
        "rdfs_range_class": edge(resolved.where("class_key IS NOT NULL"), "id", "class_key"),
        "subclass_of": edge(above, "owner", "class_key"),
        "extracted_from": edge(own.select("key", F.col("doc_id").cast("string").alias("doc"), "ontology_id"), "key", "doc"),
        "produced_by": edge(own.select(F.col("ontology_id").cast("string").alias("o"), F.col("run_id").cast("string").alias("r"), "ontology_id"), "o", "r"),
    }


def multi_signal_confidence(classes: DataFrame, domain: DataFrame, subclass: DataFrame, ranges: DataFrame, provenance: DataFrame) -> DataFrame:
    """key and confidence of each class by all signals, from counts per class; edges count whether expired or not.

    classes: key, agreement, faithfulness, validity, property_agreement (nulls: 0.5, 0.5, 0.5, 1), description.  domain: class_key
    and kind (datatype or object) of properties; subclass: src, dst; ranges: class_key; provenance: class_key.
    """
    n = lambda df, key, **counts: df.groupBy(F.col(key).alias("key")).agg(*[c.alias(name) for name, c in counts.items()])
    parts = [
        n(domain, "class_key", datatype=F.count(F.when(F.col("kind") == "datatype", 1)), object=F.count(F.when(F.col("kind") == "object", 1))),
        n(subclass, "src", parents=F.count("*")),
        n(subclass, "dst", children=F.count("*")),
        n(ranges, "class_key", ranged=F.count("*")),
        n(provenance, "class_key", sources=F.count("*")),
    ]
    copies = classes.groupBy("description").agg(F.count("*").alias("copies"))
    own = reduce(lambda df, part: df.join(part, "key", "left"), parts, classes).join(copies.withColumnRenamed("description", "_d"), F.col("description").eqNullSafe(F.col("_d")), "left")
    count = lambda name: F.coalesce(F.col(name), F.lit(0))
    signals = {
        "agreement": F.coalesce("agreement", F.lit(0.5)),
        "faithfulness": F.coalesce("faithfulness", F.lit(0.5)),
        "validity": F.coalesce("validity", F.lit(0.5)),
        "structural": S.structural_score(count("datatype"), count("object"), count("parents") > 0, count("children") > 0, (count("object") > 0) | (count("ranged") > 0)),
        "description": S.description_score(F.col("description"), count("copies")),
        "provenance": S.provenance_score(count("sources")),
        "property_agreement": F.coalesce("property_agreement", F.lit(1.0)),
        "evidence_count": F.lit(1.0),
        "evidence_age": F.lit(1.0),
    }
    return own.select("key", S.class_confidence(signals).alias("confidence"))


def judge_scores(answers: DataFrame, wanted: DataFrame) -> DataFrame:
    """batch, uri, score for every wanted (batch, uri): of the answer's last entry for the uri; 0.5 where it has none or is no JSON.

    answers: batch, raw, a JSON object with results (uri, rating), in a code fence or not.
    """
    parsed = F.from_json(X.fenced(F.col("raw")), "results array<struct<uri:string,rating:string>>")
    entries = answers.select("batch", F.posexplode(parsed["results"]).alias("nth", "e")).select("batch", "nth", "e.uri", "e.rating").where("uri <> ''")
    last = entries.groupBy("batch", "uri").agg(F.max_by(F.coalesce("rating", F.lit("")), "nth").alias("rating"))
    return wanted.join(last, ["batch", "uri"], "left").select("batch", "uri", X.rating_score(F.col("rating")).alias("score"))


def chunk_kind(text: Column) -> Column:
    """visual: only lines on pictures; mixed: such lines and others; text: none of them."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\R"), lambda x: F.trim(x)), lambda x: x != "")
    begins = lambda marks: lambda x: reduce(lambda a, b: a | b, [F.startswith(x, F.lit(m)) for m in marks])
    visual = F.exists(lines, begins(VISUAL_BODY))
    body = F.exists(lines, lambda x: ~begins(VISUAL_MARKER)(x))
    return F.when(visual & ~body, "visual").when(visual, "mixed").otherwise("text")


def visual_context(chunks: DataFrame, sections: DataFrame) -> DataFrame:
    """chunks (doc_id, section, text, ...) with chunk_kind and visual_assets: the assets that their section names by index; indexes out of range are left out.

    sections: doc_id, section, asset_indexes (array of int), assets (array).
    """
    named = sections.select("doc_id", "section", F.filter(F.transform("asset_indexes", lambda i: F.get("assets", i)), lambda x: x.isNotNull()).alias("visual_assets"))
    return chunks.withColumn("chunk_kind", chunk_kind(F.col("text"))).join(named, ["doc_id", "section"], "left")


def delete_documents(documents: DataFrame, chunks: DataFrame, provenance: DataFrame, gone: DataFrame, now: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """documents and chunks without those of gone (doc_id), and provenance (doc_id, expired) with their live edges expired at now."""
    keys = gone.select("doc_id").distinct()
    hit = provenance.join(keys.withColumn("_hit", F.lit(True)), "doc_id", "left")
    expired = F.when(F.col("_hit") & F.col("expired").isNull(), F.lit(now)).otherwise(F.col("expired"))
    return documents.join(keys, "doc_id", "left_anti"), chunks.join(keys, "doc_id", "left_anti"), hit.withColumn("expired", expired).drop("_hit")


def deletion_report(chunks: DataFrame, provenance: DataFrame, gone: DataFrame) -> DataFrame:
    """What a deletion would touch, without doing it: doc_id, chunks and live provenance edges."""
    keys = gone.select("doc_id").distinct()
    c = chunks.join(keys, "doc_id", "left_semi").groupBy("doc_id").agg(F.count("*").alias("chunks"))
    e = provenance.where("expired IS NULL").join(keys, "doc_id", "left_semi").groupBy("doc_id").agg(F.count("*").alias("edges"))
    none = F.lit(0).cast("long")
    return keys.join(c, "doc_id", "left").join(e, "doc_id", "left").select("doc_id", F.coalesce("chunks", none).alias("chunks"), F.coalesce("edges", none).alias("edges"))
