"""Schema sources: fields inferred from JSON, table catalogues as ontologies, and file sources and sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import infer_xsd


def json_fields(df: DataFrame, column: str) -> DataFrame:
    """field, xsd and rows of the fields of JSON objects; mixed types are strings, nulls and nested values have no type."""
    pairs = df.select(F.explode(F.from_json(column, "map<string,string>")).alias("field", "value")).withColumn("xsd", infer_xsd(F.col("value")))
    kinds = F.countDistinct("xsd")
    return pairs.groupBy("field").agg(F.when(kinds > 1, "xsd:string").otherwise(F.max("xsd")).alias("xsd"), F.count("*").alias("n"))


def jsonschema_type(format_: Column, type_: Column) -> Column:
    """XSD type of a JSON schema entry; the format wins over the type."""
    by_format = F.when(format_ == "date", "xsd:date").when(format_ == "date-time", "xsd:dateTime").when(format_ == "uri", "xsd:anyURI")
    by_type = F.when(type_ == "integer", "xsd:integer").when(type_ == "number", "xsd:decimal").when(type_ == "boolean", "xsd:boolean").otherwise("xsd:string")
    return F.coalesce(by_format, by_type)


def table_fields(tables: dict[str, DataFrame], spark: SparkSession) -> DataFrame:
    """table, field, type and nullable of given tables: classes and datatype properties of a relational schema."""
    rows = [(name, f.name, f.dataType.simpleString(), f.nullable) for name, df in tables.items() for f in df.schema.fields]
    return spark.createDataFrame(rows, "table string, field string, type string, nullable boolean")


def unique_fields(indexes: DataFrame) -> DataFrame:
    """table and field of unique indexes over one field (table, fields array, is_unique): their maxCount is 1."""
    return indexes.where("is_unique AND size(fields) = 1").select("table", F.col("fields")[0].alias("field"), F.lit("maxCount").alias("kind"), F.lit(1).alias("value"))


def rule_constraints(rules: DataFrame, column: str = "rule") -> DataFrame:
    """on_class, field, kind, value rows of JSON schema rules (on_class, rule)."""
    shape = "required array<string>, properties map<string, struct<type:string, pattern:string, enum:array<string>>>"
    own = rules.select("on_class", F.from_json(column, shape).alias("r"))
    required = own.select("on_class", F.explode("r.required").alias("field"), F.lit("minCount").alias("kind"), F.lit("1").alias("value"))
    props = own.select("on_class", F.explode("r.properties").alias("field", "spec"))
    each = F.array(F.struct(F.lit("datatype").alias("kind"), F.col("spec.type").alias("value")), F.struct(F.lit("pattern").alias("kind"), F.col("spec.pattern").alias("value")), F.struct(F.lit("in").alias("kind"), F.array_join("spec.enum", "|").alias("value")))
    rest = props.select("on_class", "field", F.explode(each).alias("c")).select("on_class", "field", "c.kind", "c.value").where("value IS NOT NULL")
    return required.unionByName(rest)


def binary_sections(files: DataFrame, parser: Callable[[bytes], Iterable[tuple[int, str, str]]]) -> DataFrame:
    """path, page, heading, body of binary documents (path, content), by a given parser; parsers for office formats are plug-ins."""

    def run(frames):
        for frame in frames:
            rows = [(path, *row) for path, content in zip(frame["path"], frame["content"]) for row in parser(content)]
            yield pd.DataFrame(rows, columns=["path", "page", "heading", "body"])

    return files.select("path", "content").mapInPandas(run, "path string, page int, heading string, body string")


def mime_kind(mime: Column) -> Column:
    return F.when(mime == "application/pdf", "pdf").when(mime.contains("wordprocessingml"), "docx").when(mime.contains("presentationml"), "pptx").when(mime == "application/msword", "doc").when(mime.startswith("text/"), "markdown")


def html_text(html: Column) -> Column:
    """The text of an HTML page: without scripts, styles and tags, white space collapsed."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    bare = F.regexp_replace(bare, r"(?s)<[^>]*>", " ")
    for mark, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(mark), F.lit(char))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def csv_lines(df: DataFrame, columns: list[str]) -> DataFrame:
    """One column, line: the rows as CSV text."""
    return df.select(F.to_csv(F.struct(*columns)).alias("line"))


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, head, relation, tail of gold documents in JSON lines: {doc_id, vertices: [..], triples: [{h, r, t}]}; dangling indexes are left out."""
    docs = spark.read.schema("doc_id string, vertices array<string>, triples array<struct<h:int,r:string,t:int>>").json(path)
    rows = docs.select("doc_id", "vertices", F.explode("triples").alias("x"))
    out = rows.select("doc_id", F.get("vertices", F.col("x.h")).alias("head"), F.col("x.r").alias("relation"), F.get("vertices", F.col("x.t")).alias("tail"))
    return out.where("head IS NOT NULL AND tail IS NOT NULL")
