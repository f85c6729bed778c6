"""Sections, chunks, windows over sequences, paging and text search."""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip


def markdown_sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, section (0 before the first heading), heading, level and body of each document's sections."""
    lines = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("pos", "line"))
    level = F.length(F.regexp_extract("line", r"^(#{1,6})\s+", 1))
    run = Window.partitionBy("doc_id").orderBy("pos")
    marked = lines.withColumn("level", level).withColumn("section", F.sum((F.col("level") > 0).cast("int")).over(run).cast("int"))
    heading = F.max(F.when(F.col("level") > 0, F.trim(F.regexp_replace("line", r"^#{1,6}\s+", ""))))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("level") == 0, F.struct("pos", "line")))), lambda x: x["line"]), "\n")
    return marked.groupBy("doc_id", "section").agg(heading.alias("heading"), F.max("level").alias("level"), strip(body).alias("body"))


def paragraphs(text: str) -> list[str]:
    return [p.strip() for p in re.split(r"\n\s*\n", text) if p.strip()]


def split_long(text: str, budget: int) -> list[str]:
    """Runs of `budget` words."""
    words = text.split()
    return [" ".join(words[i : i + budget]) for i in range(0, len(words), budget)]


def pack(sizes: list[int], budget: int, overlap: int) -> list[tuple[int, int]]:
    """Runs start..end-1 of consecutive paragraphs within the budget.

    A run that follows another within the same stretch starts with that one's last paragraphs, as many as fit the overlap.  A
    paragraph above the budget stands alone and has no overlap on either side.
    """
    out, start, total = [], 0, 0
    for i, n in enumerate(sizes):
        if n > budget:
            if start < i:
                out.append((start, i))
            out.append((i, i + 1))
            start, total = i + 1, 0
            continue
        if start < i and total + n > budget:
            out.append((start, i))
            first, start, total = start, i, 0
            while start > first and total + sizes[start - 1] <= overlap:
                start -= 1
                total += sizes[start]
        total += n
    if start < len(sizes):
        out.append((start, len(sizes)))
    return out


def packed(text: str, budget: int, overlap: int) -> list[str]:
    """Pieces of a section's text."""
    parts = paragraphs(text)
    sizes = [len(p.split()) for p in parts]
    out = []
    for a, b in pack(sizes, budget, overlap):
        out += split_long(parts[a], budget) if sizes[a] > budget else ["\n\n".join(parts[a:b])]
    return out


def category(form: Column) -> Column:
    """Category of a document's format, which selects its chunker."""
    return F.when(F.lower(form) == "pptx", "deck").otherwise("narrative")


def title_base(title: Column) -> Column:
    """A slide title without marks of continuation and trailing numbers, lower-cased."""
    bare = F.regexp_replace(F.trim(F.coalesce(title, F.lit(""))), r"(?i)\s*[(\[]?\s*(?:cont(?:inued|'d|d)?\.?)\s*[)\]]?\s*$", "")
    return F.lower(F.trim(F.regexp_replace(bare, r"\s*[(\[]?\s*\d+\s*[)\]]?\s*$", "")))


_CHUNK = "doc_id long, section int, page int, heading string, role string, part int, parts int, text string, token_count int, nth int"


def chunk_sections(sections: DataFrame, max_tokens: int = 512, overlap: int = 0) -> DataFrame:
    """Chunks of sections (doc_id, form, section, page, heading, body, notes) with chunk_index, a number within the document, and topic_unit.

    A section is never merged with another one; its heading leads its text.  The format's category decides: in narratives
    notes follow the body; in decks they are chunks of the role notes, part and parts say how an oversized slide was split
    (else null), and slides whose titles go on with one topic share a topic_unit.  Tokens are words; the overlap is held to
    half of max_tokens.  Sections are packed one by one, without a shuffle; only numbers are made by windows over the
    document's chunks, whose texts stay out of it.
    """
    overlap = max(0, min(overlap, max_tokens // 2))

    def run(frames):
        for frame in frames:
            rows = []
            for doc, form, section, page, heading, body, notes in zip(*(frame[c] for c in ("doc_id", "form", "section", "page", "heading", "body", "notes"))):
                deck, heading, body, notes = form == "deck", heading or "", body or "", notes or ""
                if notes and not deck:
                    body = f"{body}\n[Notes] {notes}" if body else f"[Notes] {notes}"
                pieces = packed(f"{heading}\n\n{body}" if heading and body else body or (heading if deck else ""), max_tokens, overlap)
                many = deck and len(pieces) > 1
                for k, text in enumerate(pieces):
                    rows.append((doc, section, page, heading, "slide" if deck else "body", k + 1 if many else None, len(pieces) if many else None, text, len(text.split()), k))
                if deck and notes:
                    for k, text in enumerate(packed(notes, max_tokens, overlap)):
                        rows.append((doc, section, page, heading, "notes", None, None, text, len(text.split()), k))
            yield pd.DataFrame(rows, columns=["doc_id", "section", "page", "heading", "role", "part", "parts", "text", "token_count", "nth"]).astype({"part": "Int32", "parts": "Int32", "page": "Int32"})

    own = sections.select(F.col("doc_id").cast("long"), category(F.col("form")).alias("form"), "section", F.col("page").cast("int").alias("page"), "heading", "body", "notes")
    chunks = own.mapInPandas(run, _CHUNK)
    units = topic_units(sections.where(category(F.col("form")) == "deck").select(F.col("doc_id").cast("long").alias("doc_id"), "section", "heading"), "doc_id", "section", title_base(F.col("heading"))).select("doc_id", "section", F.col("unit").alias("topic_unit"))
    order = Window.partitionBy("doc_id").orderBy("section", F.col("role").desc(), "nth")
    return chunks.join(units, ["doc_id", "section"], "left").withColumn("chunk_index", (F.row_number().over(order) - 1).cast("int")).drop("nth")


#: White space of Python that ends no word where words end at ASCII white space.
_WITHIN = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \t\n\f\r")


def running(text: Column) -> Column:
    """The text without spaces of any kind around it as one run of words, which end at ASCII white space: no blank lines part it, and other white space inside is part of a word (as _)."""
    bare = F.regexp_replace(text, r"^\p{Zs}+|\p{Zs}+$", "")
    return F.translate(F.regexp_replace(bare, "[ \t\n\f\r]+", " "), _WITHIN, "_" * len(_WITHIN))


def chunk_documents(docs: DataFrame, max_tokens: int = 512, overlap: int = 0, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), empty: bool = False) -> DataFrame:
    """doc_id, chunk_index, text, token_count: paragraphs of whole texts packed up to max_tokens words; longer ones are split at words.

    The overlap is held to half of max_tokens.  A document is packed by itself, so no shuffle is needed.  keep: columns without
    nulls that go with each chunk.  empty: texts without words are one chunk of 0 words, null texts one with nulls.
    """
    overlap = min(overlap, max_tokens // 2)

    def run(frames):
        for frame in frames:
            rows = []
            for doc, text, *more in zip(frame[id_col], frame[text_col], *(frame[c] for c in keep)):
                pieces = packed(text or "", max_tokens, overlap) or (["" if text is not None else None] if empty else [])
                rows += [(doc, k, piece, None if piece is None else len(piece.split()), *more) for k, piece in enumerate(pieces)]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "text", "token_count", *keep]).astype({"token_count": "Int32"})

    kept = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(id_col, text_col, *keep).mapInPandas(run, f"doc_id long, chunk_index int, text string, token_count int{kept}")


def batches_by_budget(df: DataFrame, group: str, order: list[str], size: Column, budget: int, most: int) -> DataFrame:
    """df with the batch of each row: consecutive rows within a token budget and a number of rows.

    Rows come sorted, and only the open batch's sums are carried, so a task never holds a group.
    """

    def run(batches):
        key, batch, total, n = None, 0, 0, 0
        for part in batches:
            out = []
            for g, s in zip(part.column(group).to_pylist(), part.column("_size").to_pylist()):
                if (g,) != key:
                    key, batch, total, n = (g,), 0, 0, 0
                if n and (total + (s or 0) > budget or n >= most):
                    batch, total, n = batch + 1, 0, 0
                total, n = total + (s or 0), n + 1
                out.append(batch)
            names = [c for c in part.schema.names if c != "_size"]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(out, pa.int32())], [*names, "batch"])

    own = df.withColumn("_size", size.cast("long")).repartition(group).sortWithinPartitions(group, *order)
    return own.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("batch", T.IntegerType())]))


def topic_units(df: DataFrame, group: str, order: str, title: Column) -> DataFrame:
    """df with unit: a new one begins where the title changes or is empty."""
    w = Window.partitionBy(group).orderBy(order)
    t = df.withColumn("_t", title)
    new = (F.coalesce(F.col("_t"), F.lit("")) == "") | ~F.col("_t").eqNullSafe(F.lag("_t").over(w))
    return t.withColumn("_new", new.cast("int")).withColumn("unit", F.sum("_new").over(w).cast("int")).drop("_t", "_new")


def inherit_previous(df: DataFrame, group: str, order: str, column: str) -> DataFrame:
    """Null values take the nearest one before them."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(column, F.last(column, ignorenulls=True).over(w))


def evenly(total: Column, cap: int) -> Column:
    """Indices of a sample of cap items, evenly spaced."""
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.least(total, F.lit(cap)) - 1), lambda i: F.floor(i * total / F.least(total, F.lit(cap))).cast("int")))


def page_after(df: DataFrame, sort: str, key: str, after: tuple | None, limit: int) -> DataFrame:
    """The page after (sort value, key), with one row more to tell whether there is a next one; limit is held to 1..100."""
    limit = min(max(limit, 1), 100)
    if after:
        df = df.where((F.col(sort) > after[0]) | ((F.col(sort) == after[0]) & (F.col(key) > after[1])))
    return df.orderBy(sort, key).limit(limit + 1)


def bm25(rows: DataFrame, words: list[str], id_col: str, fields: dict[str, tuple[Column, float]], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """id and BM25 score of rows that have any of the words: the sum of each field's score times its boost.

    Each text is cut into words once; what goes on is a row for each hit of a row, field and word, and the counts of each field.
    """
    name = lambda f, x: f"_{f}_{x}"
    array = rows.select(F.col(id_col).alias("id"), *[F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "").alias(f) for f, (text, _) in fields.items()])
    size = [F.size(f).alias(name(f, "size")) for f in fields]
    tf = [F.size(F.filter(f, (lambda w: lambda x: x == w)(w))).alias(name(f, i)) for f in fields for i, w in enumerate(words)]
    counted = array.select("id", *size, *tf)
    stats = counted.agg(F.count("*").alias("_n"), *[F.avg(name(f, "size")).alias(name(f, "avg")) for f in fields], *[F.count(F.when(F.col(name(f, i)) > 0, 1)).alias(name(f, f"df{i}")) for f in fields for i in range(len(words))])
    any_hit = F.greatest(F.lit(0), *[F.col(name(f, i)) for f in fields for i in range(len(words))]) > 0
    score = F.lit(0.0)
    for f, (_, boost) in fields.items():
        norm = F.lit(k1) * (1 - b + b * F.col(name(f, "size")) / F.col(name(f, "avg")))
        for i in range(len(words)):
            n, df = F.col(name(f, i)), F.col(name(f, f"df{i}"))
            idf = F.log(1 + (F.col("_n") - df + 0.5) / (df + 0.5))
            score = score + F.when(n > 0, boost * idf * n * (k1 + 1) / (n + norm)).otherwise(0.0)
    return counted.where(any_hit).join(F.broadcast(stats)).select("id", score.alias("score"))  # stats is one row
