"""Extraction of mentions and relations from chunks, and individuals made of them.

An extractor takes chunks (doc_id, chunk_id, text) and gives mentions (doc_id, chunk_id, nth, label, type) and relations
(doc_id, chunk_id, nth, head, relation, tail); `words` is one without a model, and a model's answers parsed into the same
columns take its place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import locate_span, span_union
from .core import hinted

Extractor = Callable[[DataFrame], tuple[DataFrame, DataFrame]]

#: Verbs that make a relation of the capitalised words beside them.
VERBS = ("is", "has", "uses", "contains", "owns", "knows")
_WORD = r"\b([A-Z][a-zA-Z][a-zA-Z0-9_-]+)\b"


def words(types: Mapping[str, str] | None = None, verbs: Iterable[str] = VERBS) -> Extractor:
    """An extractor by rule: capitalised words of three letters and more, and those on both sides of a verb within a sentence.

    types: type of a label, empty for others.  A label counts once a chunk, at its first place; so does a relation.
    """
    verbs = sorted(set(verbs))

    def extract(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
        text = F.coalesce("text", F.lit(""))
        found = chunks.select("doc_id", "chunk_id", F.posexplode(F.array_distinct(F.regexp_extract_all(text, F.lit(_WORD), F.lit(1)))).alias("nth", "label"))
        kind = F.create_map(*[F.lit(x) for pair in types.items() for x in pair])[F.col("label")] if types else F.lit(None).cast("string")
        mentions = found.withColumn("type", F.coalesce(kind, F.lit("")))
        bare = lambda x, marks: F.regexp_replace(x, f"[{marks}]+$", "")
        sentences = chunks.select("doc_id", "chunk_id", F.posexplode(F.regexp_extract_all(text, F.lit(r"([^.!?]+[.!?])"), F.lit(1))).alias("s", "sentence"))
        tokens = sentences.select("doc_id", "chunk_id", "s", F.filter(F.split("sentence", r"\s+"), lambda x: x != "").alias("t"))
        place = F.posexplode(F.arrays_zip(F.slice("t", 1, F.greatest(F.size("t") - 2, F.lit(0))).alias("h"), F.slice("t", 2, F.greatest(F.size("t") - 2, F.lit(0))).alias("v"), F.slice("t", 3, F.greatest(F.size("t") - 2, F.lit(0))).alias("o")))
        triples = tokens.select("doc_id", "chunk_id", "s", place.alias("i", "x")).select("doc_id", "chunk_id", "s", "i", bare(F.col("x.h"), ",;:").alias("head"), bare(F.lower("x.v"), ",;:").alias("relation"), bare(F.col("x.o"), ".,;:!?").alias("tail"))
        starts = lambda c: F.col(c).rlike("^" + _WORD)
        good = triples.where(F.col("relation").isin(verbs) & starts("head") & starts("tail"))
        relations = good.groupBy("doc_id", "chunk_id", "head", "relation", "tail").agg(F.min(F.struct("s", "i")).alias("first"))
        return mentions, relations.select("doc_id", "chunk_id", F.struct(F.col("first.s"), F.col("first.i")).alias("nth"), "head", "relation", "tail")

    return extract


def individuals(chunks: DataFrame, mentions: DataFrame, relations: DataFrame, classes: DataFrame, guided: bool = True) -> tuple[DataFrame, DataFrame]:
    """Individuals and assertions of chunks (ontology, doc_id, chunk_id, text): one individual for a class and label, whatever its case.

    classes: ontology, key, label; of classes with one label the smallest key counts.  guided: mentions without a class of
    the chunk's ontology are left out, else they have an empty class.  An individual has its label and span from its first
    mention by doc_id, chunk_id and nth; labels of assertions are those of their own chunk (of several mentions the last), and
    an assertion's span covers both.  Mentions and relations as an extractor gives them, chunk_id one within a document.
    """
    keys = classes.groupBy("ontology", F.lower("label").alias("_type")).agg(F.min("key").cast("string").alias("class_key"))
    own = chunks.select("ontology", "doc_id", "chunk_id", "text")
    placed = mentions.withColumn("label", F.trim("label")).where("label <> ''").join(own, ["doc_id", "chunk_id"])
    placed = placed.withColumn("_type", F.lower(F.trim("type"))).join(hinted(keys), ["ontology", "_type"], "left" if not guided else "inner")
    name = F.lower("label")
    key = F.sha2(F.to_json(F.struct("ontology", F.coalesce("class_key", F.lit("")), name)), 256)
    placed = placed.select("ontology", "doc_id", "chunk_id", "nth", "label", F.coalesce("class_key", F.lit("")).alias("class_key"), name.alias("name"), key.alias("key"), locate_span(F.col("text"), F.col("label")).alias("span"))
    first = F.min_by(F.struct("label", "doc_id", "chunk_id", "span"), F.struct("doc_id", "chunk_id", "nth"))
    made = placed.groupBy("key", "ontology", "class_key").agg(first.alias("m")).select("key", "ontology", "class_key", "m.label", "m.doc_id", "m.chunk_id", F.col("m.span.start").alias("start"), F.col("m.span.end").alias("end"))
    local = placed.groupBy("ontology", "doc_id", "chunk_id", "name").agg(F.max_by(F.struct("key", "span"), "nth").alias("m"))

    def side(c: str, to: str) -> DataFrame:
        return local.select("doc_id", "chunk_id", "ontology", F.col("name").alias(c), F.col("m.key").alias(to), F.col("m.span").alias(f"{to}_span"))

    said = relations.where("trim(relation) <> ''").select("doc_id", "chunk_id", F.lower(F.trim("head")).alias("_head"), F.trim("relation").alias("predicate"), F.lower(F.trim("tail")).alias("_tail"))
    both = said.join(side("_head", "src"), ["doc_id", "chunk_id", "_head"]).join(side("_tail", "dst"), ["doc_id", "chunk_id", "ontology", "_tail"])
    span: Column = span_union(F.col("src_span.start"), F.col("src_span.end"), F.col("dst_span.start"), F.col("dst_span.end"))
    return made, both.select("ontology", "src", "predicate", "dst", "doc_id", "chunk_id", span.alias("span"))
