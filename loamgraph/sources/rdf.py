"""Triples: reading N-Triples, ontology tables from triples and back, restrictions and shapes.

A triple is a row s, p, o, kind ('iri', 'literal' or 'blank' of the object), datatype, lang.  Other syntaxes need a parser
library, which can be plugged in through `parse_with`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: terms of the RDF, RDFS, OWL and SHACL vocabularies
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
SH = "http://www.w3.org/ns/shacl#"

_TRIPLE = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:\^\^<[^>]*>|@[A-Za-z0-9-]+)?)\s*\.\s*$'


def parse_ntriples(lines: DataFrame, column: str = "value") -> DataFrame:
    """Triples of lines of N-Triples; comments, blank and malformed lines are left out."""
    get = lambda i: F.regexp_extract(column, _TRIPLE, i)
    raw = lines.where(F.col(column).rlike(_TRIPLE)).select(get(1).alias("_s"), get(2).alias("p"), get(3).alias("_o"))
    name = lambda c: F.when(F.col(c).startswith("<"), F.expr(f"substring({c}, 2, length({c}) - 2)")).otherwise(F.col(c))
    kind = F.when(F.col("_o").startswith("<"), "iri").when(F.col("_o").startswith("_:"), "blank").otherwise("literal")
    text = F.regexp_extract("_o", r'^"((?:[^"\\]|\\.)*)"', 1)
    for mark, char in (("\\n", "\n"), ("\\t", "\t"), ('\\"', '"'), ("\\\\", "\\")):
        text = F.replace(text, F.lit(mark), F.lit(char))
    empty = lambda c: F.when(c != "", c)
    datatype, lang = empty(F.regexp_extract("_o", r"\^\^<([^>]*)>$", 1)), empty(F.regexp_extract("_o", r'"@([A-Za-z0-9-]+)$', 1))
    literal = kind == "literal"
    return raw.select(name("_s").alias("s"), "p", F.when(literal, text).otherwise(name("_o")).alias("o"), kind.alias("kind"), F.when(literal, datatype).alias("datatype"), F.when(literal, lang).alias("lang"))


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    return parse_ntriples(spark.read.text(path))


def parse_with(files: DataFrame, parser: Callable[[bytes, str], Iterable[tuple]]) -> DataFrame:
    """Triples of binary files (path, content) by a given parser of (content, path) to (s, p, o, kind, datatype, lang)."""

    def run(frames):
        for frame in frames:
            rows = [row for path, content in zip(frame["path"], frame["content"]) for row in parser(content, path)]
            yield pd.DataFrame(rows, columns=["s", "p", "o", "kind", "datatype", "lang"])

    return files.select("path", "content").mapInPandas(run, "s string, p string, o string, kind string, datatype string, lang string")


def to_ntriples(triples: DataFrame) -> DataFrame:
    """One column, value: the lines of N-Triples."""
    name = lambda c: F.when(F.col(c).startswith("_:"), F.col(c)).otherwise(F.concat(F.lit("<"), F.col(c), F.lit(">")))
    text = F.col("o")
    for char, mark in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t")):
        text = F.replace(text, F.lit(char), F.lit(mark))
    tail = F.when(F.col("lang").isNotNull(), F.concat(F.lit("@"), "lang")).when(F.col("datatype").isNotNull(), F.concat(F.lit("^^<"), "datatype", F.lit(">"))).otherwise("")
    o = F.when(F.col("kind") == "literal", F.concat(F.lit('"'), text, F.lit('"'), tail)).otherwise(name("o"))
    return triples.select(F.concat(name("s"), F.lit(" <"), "p", F.lit("> "), o, F.lit(" .")).alias("value"))


def write_ntriples(triples: DataFrame, path: str) -> None:
    to_ntriples(triples).write.mode("overwrite").text(path)


def triple(s, p: str, o, kind: str = "iri", datatype: str | None = None):
    return F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("kind"), F.lit(datatype).cast("string").alias("datatype"), F.lit(None).cast("string").alias("lang"))


def from_rows(df: DataFrame, *parts) -> DataFrame:
    """Triples of each row: the structs of `triple`; those with a null end are left out."""
    out = df.select(F.explode(F.array(*parts)).alias("t")).select("t.*")
    return out.where("s IS NOT NULL AND o IS NOT NULL")


def class_triples(classes: DataFrame) -> DataFrame:
    """Type, label and comment of classes (uri, label, description)."""
    u = F.col("uri")
    return from_rows(classes, triple(u, RDF + "type", F.lit(OWL + "Class")), triple(u, RDFS + "label", F.col("label"), "literal"), triple(u, RDFS + "comment", F.col("description"), "literal"))


def edge_triples(edges: DataFrame) -> DataFrame:
    """Triples of edges (src, dst, edge_type): subclass_of, equivalent_class, imports and rdf_type; others have no triple."""
    pick = F.when(F.col("edge_type") == "subclass_of", RDFS + "subClassOf").when(F.col("edge_type") == "equivalent_class", OWL + "equivalentClass").when(F.col("edge_type") == "imports", OWL + "imports").when(F.col("edge_type") == "rdf_type", RDF + "type")
    none = F.lit(None).cast("string")
    return edges.select(F.col("src").alias("s"), pick.alias("p"), F.col("dst").alias("o"), F.lit("iri").alias("kind"), none.alias("datatype"), none.alias("lang")).where("p IS NOT NULL")


def restriction_triples(constraints: DataFrame) -> DataFrame:
    """Blank-node restrictions of constraints (on_class, property_uri, kind, value): four triples each."""
    node = F.concat(F.lit("_:r"), F.md5(F.concat_ws("|", "on_class", "property_uri", "kind", "value")))
    base = constraints.withColumn("_n", node)
    value = F.col("value").cast("string")
    out = from_rows(base, triple(F.col("on_class"), RDFS + "subClassOf", F.col("_n"), "blank"), triple(F.col("_n"), RDF + "type", F.lit(OWL + "Restriction")), triple(F.col("_n"), OWL + "onProperty", F.col("property_uri")))
    none = F.lit(None).cast("string")
    bound = base.where(F.col("value").isNotNull()).select(F.col("_n").alias("s"), F.concat(F.lit(OWL), F.col("kind")).alias("p"), value.alias("o"), F.lit("literal").alias("kind"), F.lit(XSD + "nonNegativeInteger").alias("datatype"), none.alias("lang"))
    return out.unionByName(bound)


def classes_of(triples: DataFrame) -> DataFrame:
    """uri, label, description of classes; blank nodes are left out."""
    own = triples.where((F.col("p") == RDF + "type") & F.col("o").isin(OWL + "Class", RDFS + "Class") & ~F.col("s").startswith("_:")).select(F.col("s").alias("uri")).distinct()
    text = lambda p, name: triples.where((F.col("p") == p) & (F.col("kind") == "literal")).groupBy(F.col("s").alias("uri")).agg(F.min("o").alias(name))
    return own.join(text(RDFS + "label", "label"), "uri", "left").join(text(RDFS + "comment", "description"), "uri", "left")


def properties_of(triples: DataFrame) -> DataFrame:
    """uri, kind (object or datatype), domain and range."""
    own = triples.where((F.col("p") == RDF + "type") & F.col("o").isin(OWL + "ObjectProperty", OWL + "DatatypeProperty")).groupBy(F.col("s").alias("uri")).agg(F.max(F.when(F.col("o") == OWL + "ObjectProperty", "object").otherwise("datatype")).alias("kind"))
    end = lambda p, name: triples.where(F.col("p") == p).groupBy(F.col("s").alias("uri")).agg(F.min("o").alias(name))
    return own.join(end(RDFS + "domain", "domain"), "uri", "left").join(end(RDFS + "range", "range"), "uri", "left")


def subclass_edges_of(triples: DataFrame) -> DataFrame:
    return triples.where((F.col("p") == RDFS + "subClassOf") & (F.col("kind") == "iri")).select(F.col("s").alias("src"), F.col("o").alias("dst")).distinct()


def restrictions_of(triples: DataFrame) -> DataFrame:
    """on_class, property_uri, kind and value of plain restrictions under subClassOf or equivalentClass; qualified ones are left out."""
    nodes = triples.where((F.col("p") == RDF + "type") & (F.col("o") == OWL + "Restriction")).select(F.col("s").alias("n"))
    held = triples.where(F.col("p").isin(RDFS + "subClassOf", OWL + "equivalentClass") & (F.col("kind") == "blank")).select(F.col("s").alias("on_class"), F.col("o").alias("n"))
    on = triples.where(F.col("p") == OWL + "onProperty").select(F.col("s").alias("n"), F.col("o").alias("property_uri"))
    kinds = ("minCardinality", "maxCardinality", "cardinality", "someValuesFrom", "allValuesFrom", "hasValue")
    value = triples.where(F.col("p").isin(*[OWL + k for k in kinds])).select(F.col("s").alias("n"), F.replace(F.col("p"), F.lit(OWL), F.lit("")).alias("kind"), F.col("o").alias("value"))
    return held.join(nodes, "n", "left_semi").join(on, "n").join(value, "n").select("on_class", "property_uri", "kind", "value")


def shapes_of(triples: DataFrame) -> DataFrame:
    """on_class, property_uri, kind and value of property shapes with a plain path; shapes with and, or, not, xone are left out."""
    deferred = triples.where(F.col("p").isin(*[SH + k for k in ("and", "or", "not", "xone", "qualifiedValueShape", "sparql")])).select(F.col("s").alias("shape")).distinct()
    target = triples.where(F.col("p") == SH + "targetClass").select(F.col("s").alias("node"), F.col("o").alias("on_class"))
    has = triples.where(F.col("p") == SH + "property").select(F.col("s").alias("node"), F.col("o").alias("shape"))
    path = triples.where((F.col("p") == SH + "path") & (F.col("kind") == "iri")).select(F.col("s").alias("shape"), F.col("o").alias("property_uri"))
    kinds = ("minCount", "maxCount", "datatype", "class", "pattern", "minLength", "maxLength", "nodeKind", "hasValue")
    value = triples.where(F.col("p").isin(*[SH + k for k in kinds])).select(F.col("s").alias("shape"), F.replace(F.col("p"), F.lit(SH), F.lit("")).alias("kind"), F.col("o").alias("value"))
    return target.join(has, "node").join(deferred, "shape", "left_anti").join(path, "shape").join(value, "shape").select("on_class", "property_uri", "kind", "value")


def shape_triples(constraints: DataFrame) -> DataFrame:
    """Shapes of constraints (on_class, property_uri, kind, value): one node shape for each class, one property shape for each property."""
    node = F.concat(F.col("on_class"), F.lit("-shape"))
    prop = F.concat(F.lit("_:p"), F.md5(F.concat_ws("|", "on_class", "property_uri")))
    base = constraints.withColumn("_n", node).withColumn("_p", prop)
    fixed = from_rows(base.dropDuplicates(["on_class", "property_uri"]), triple(F.col("_n"), RDF + "type", F.lit(SH + "NodeShape")), triple(F.col("_n"), SH + "targetClass", F.col("on_class")), triple(F.col("_n"), SH + "property", F.col("_p"), "blank"), triple(F.col("_p"), SH + "path", F.col("property_uri"))).distinct()
    none = F.lit(None).cast("string")
    counts = F.col("kind").isin("minCount", "maxCount", "minLength", "maxLength")
    ok = ~counts | F.col("value").try_cast("int").isNotNull()
    value = base.where(ok).select(F.col("_p").alias("s"), F.concat(F.lit(SH), "kind").alias("p"), F.col("value").alias("o"), F.when(F.col("kind").isin("datatype", "class", "nodeKind"), "iri").otherwise("literal").alias("kind"), F.when(counts, XSD + "integer").alias("datatype"), none.alias("lang"))
    return fixed.unionByName(value)


def rdf_list(triples: DataFrame, heads: DataFrame) -> DataFrame:
    """head, position and item of RDF lists; a list without an end or with a loop has no rows.  heads: head."""
    from ..operators.core import cut

    first = triples.where(F.col("p") == RDF + "first").select(F.col("s").alias("cell"), F.col("o").alias("item"))
    rest = triples.where(F.col("p") == RDF + "rest").select(F.col("s").alias("cell"), F.col("o").alias("next"))
    cells = cut(first.join(rest, "cell"))
    walk = cut(heads.select("head", F.col("head").alias("cell"), F.lit(0).alias("position")))
    out, ended = None, None
    for _ in range(cells.count()):  # a list with more cells has a loop
        step = cut(walk.join(cells, "cell"))
        if not step.limit(1).count():
            break
        got = step.select("head", "position", "item")
        end = step.where(F.col("next") == RDF + "nil").select("head")
        out, ended = (got, end) if out is None else (out.unionByName(got), ended.unionByName(end))
        walk = step.where(F.col("next") != RDF + "nil").select("head", F.col("next").alias("cell"), (F.col("position") + 1).alias("position"))
    return heads.select("head", F.lit(0).alias("position"), F.lit("").alias("item")).limit(0) if out is None else out.join(ended, "head", "left_semi")
