"""Column functions over labels, URIs and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def tokens(text: Column) -> Column:
    """Distinct lower-cased words; empty for null and blank."""
    return F.array_remove(F.array_distinct(F.split(F.lower(F.trim(F.coalesce(text, F.lit("")))), r"\s+")), "")


def jaccard(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    """Overlap of two arrays of distinct items; both_empty if neither has any, 0 if one has none."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(both_empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def token_overlap(a: Column, b: Column) -> Column:
    return jaccard(tokens(a), tokens(b))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine clamped to 0..1; 0 for null, empty, mismatched and zero vectors."""
    found = F.coalesce(cosine_or_null(a, b), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), found))


def cosine_or_null(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    fits = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(fits, dot(a, b) / F.when(norm > 0, norm))


def humanise(uri: Column) -> Column:
    """The fragment with camel case, acronyms, _ and - as spaces."""
    spaced = F.regexp_replace(fragment(uri), "([a-z0-9])([A-Z])", "$1 $2")
    spaced = F.regexp_replace(spaced, "([A-Z])([A-Z][a-z])", "$1 $2")
    return F.trim(F.regexp_replace(F.regexp_replace(spaced, "[_-]+", " "), r"\s+", " "))


def fragment(uri: Column) -> Column:
    """What follows the last # , else the last / ."""
    return F.element_at(F.split(F.element_at(F.split(uri, "#"), -1), "/"), -1)


def normalise_compact(label: Column) -> Column:
    """Lower case without possessive 's, letters and digits only."""
    return F.regexp_replace(F.regexp_replace(F.lower(label), "'s\\b", ""), "[^a-z0-9]", "")


def depluralise(token: Column) -> Column:
    """Singular of a word of more than three letters."""
    n = F.length(token)
    cut = lambda k: F.substring(token, F.lit(1), n - k)
    return (
        F.when(n <= 3, token)
        .when(token.endswith("ies"), F.concat(cut(3), F.lit("y")))
        .when(token.endswith("ses") | token.endswith("xes") | token.endswith("zes"), cut(2))
        .when(token.endswith("s") & ~token.endswith("ss"), cut(1))
        .otherwise(token)
    )


def normalise_tokens(label: Column) -> Column:
    """Camel case split, lower case, other characters as spaces, singular words."""
    spaced = F.lower(F.regexp_replace(F.coalesce(label, F.lit("")), "([a-z0-9])([A-Z])", "$1 $2"))
    words = F.array_remove(F.split(F.regexp_replace(spaced, "[^a-z0-9]+", " "), " "), "")
    return F.array_join(F.transform(words, depluralise), " ")


def plural_candidates(form: Column) -> Column:
    y = F.when(form.endswith("y") & (F.length(form) > 1), F.concat(F.substring(form, F.lit(1), F.length(form) - 1), F.lit("ies")))
    return F.array_compact(F.array(F.concat(form, F.lit("s")), F.concat(form, F.lit("es")), y))


def blocking_tokens(label: Column) -> Column:
    """Distinct words of the label, those of over three letters also without a final s, and all words in sorted order as one."""
    spaced = F.lower(F.regexp_replace(F.coalesce(label, F.lit("")), "([a-z0-9])([A-Z])", "$1 $2"))
    words = F.array_sort(F.array_distinct(F.array_remove(F.split(F.regexp_replace(spaced, "[^a-z0-9]+", " "), " "), "")))
    singular = F.transform(F.filter(words, lambda w: (F.length(w) > 3) & w.endswith("s")), lambda w: F.substring(w, F.lit(1), F.length(w) - 1))
    return F.array_remove(F.array_union(F.array_union(words, singular), F.array(F.array_join(words, ""))), "")


def containment_score(a: Column, b: Column) -> Column:
    """Length ratio of the compact labels if one contains the other, else 0; 1 for equals."""
    x, y = normalise_compact(F.coalesce(a, F.lit(""))), normalise_compact(F.coalesce(b, F.lit("")))
    shorter, longer = F.least(F.length(x), F.length(y)), F.greatest(F.length(x), F.length(y))
    return F.when((shorter > 0) & (x.contains(y) | y.contains(x)), shorter / longer).otherwise(F.lit(0.0))


# fixed values: suffixes of labels that name a companion class
CO_CLASSIFIER_SUFFIXES = ("Status", "Activity", "Channel", "Code", "Role", "Category", "Detail", "Profile", "Type", "Description")


def co_classifier_suffix(label: Column) -> Column:
    """The suffix of a label that has something before it, else null."""
    found = F.regexp_extract(label, f"^.+?({'|'.join(CO_CLASSIFIER_SUFFIXES)})$", 1)
    return F.when(found != "", found)


def normalise_metric(label: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(label, r"\s+", " ")))


def slide_title_base(title: Column) -> Column:
    """A title in lower case without a continuation mark and a trailing number."""
    base = F.regexp_replace(strip(F.coalesce(title, F.lit(""))), r"(?i)\s*[(\[]?\s*cont(inued|'d|d)?\.?\s*[)\]]?\s*$", "")
    return F.lower(strip(F.regexp_replace(base, r"\s*[(\[]?\s*\d+\s*[)\]]?\s*$", "")))


def paragraphs(text: Column) -> Column:
    """Trimmed non-empty pieces between blank lines."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\n\s*\n"), strip), lambda p: p != "")


def locate_span(text: Column, label: Column) -> Column:
    """start and end of the first case-insensitive place, null if there is none."""
    at = F.instr(F.lower(text), F.lower(label)) - 1
    return F.when((at >= 0) & (F.length(label) > 0), F.struct(at.alias("start"), (at + F.length(label)).alias("end")))


def span_union(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.struct(F.least(a_start, b_start).alias("start"), F.greatest(a_end, b_end).alias("end"))


def section_prefix(page: Column, heading: Column, doc_format: Column) -> Column:
    head = F.coalesce(heading, F.lit(""))
    unit = F.when(doc_format == "pptx", "Slide ").when(doc_format == "pdf", "Page ").otherwise("Section ")
    numbered = F.concat(unit, page.cast("string"), F.when(head != "", F.concat(F.lit(": "), head)).otherwise(""))
    return F.when(page.isNull(), F.when(head != "", F.concat(F.lit("[Section: "), head, F.lit("]"))).otherwise("")).otherwise(F.concat(F.lit("["), numbered, F.lit("]")))


def section_text(page: Column, heading: Column, body: Column, doc_format: Column) -> Column:
    """A section's chunk text: prefix (numbered slides and pages only) and body; the heading alone where there is neither."""
    prefix = F.when(doc_format.isin("pptx", "pdf") & page.isNotNull(), section_prefix(page, heading, doc_format))
    text = strip(F.coalesce(body, F.lit("")))
    alone = F.when(prefix.isNull() & (text == ""), strip(F.coalesce(heading, F.lit(""))))
    return F.concat_ws("\n\n", prefix, F.when(text != "", text), F.when(alone != "", alone))


# fixed values: how lines that stand for pictures, and lines that only name a place, begin
VISUAL_LINES = ("[Visual omitted:", "[Visual (alt text):", "[Visual (caption):", "[Scanned")
MARKER_LINES = (*VISUAL_LINES, "[Slide ", "[Page ")


def chunk_kind(text: Column) -> Column:
    """visual (pictures and no body), mixed (both) or text."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), strip), lambda x: x != "")
    begins = lambda x, marks: F.greatest(*[x.startswith(m) for m in marks])
    visual = F.exists(lines, lambda x: begins(x, VISUAL_LINES))
    body = F.exists(lines, lambda x: ~begins(x, MARKER_LINES))
    return F.when(visual & ~body, "visual").when(visual, "mixed").otherwise("text")


def unordered(a: Column, b: Column) -> Column:
    return F.struct(F.least(a, b).alias("low"), F.greatest(a, b).alias("high"))


# fixed values: range names in lower case and their XSD types
XSD = {"string": "xsd:string", "integer": "xsd:integer", "int": "xsd:integer", "float": "xsd:float", "double": "xsd:double", "boolean": "xsd:boolean", "date": "xsd:date", "datetime": "xsd:dateTime", "decimal": "xsd:decimal", "anyuri": "xsd:anyURI", "xsd:string": "xsd:string", "xsd:integer": "xsd:integer", "xsd:int": "xsd:int", "xsd:float": "xsd:float", "xsd:double": "xsd:double", "xsd:boolean": "xsd:boolean", "xsd:date": "xsd:date", "xsd:datetime": "xsd:dateTime", "xsd:decimal": "xsd:decimal", "xsd:anyuri": "xsd:anyURI"}


def xsd_range(name: Column) -> Column:
    """The XSD type of a range name in any case, else the name itself."""
    lookup = F.create_map(*[F.lit(x) for kv in XSD.items() for x in kv])
    return F.coalesce(F.try_element_at(lookup, F.lower(F.trim(name))), name)


def infer_xsd(value: Column) -> Column:
    """XSD type of a value given as text; null for lists, objects and null."""
    return (
        F.when(value.isNull() | (value == "null") | value.rlike(r"^\s*[\[{]"), F.lit(None))
        .when(value.rlike("^(true|false)$"), "xsd:boolean")
        .when(value.rlike(r"^[+-]?\d+$"), "xsd:integer")
        .when(value.rlike(r"^[+-]?(\d+\.\d*|\.\d+|\d+(\.\d*)?[eE][+-]?\d+)$"), "xsd:decimal")
        .when(value.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}"), "xsd:dateTime")
        .when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), "xsd:date")
        .otherwise("xsd:string")
    )


def is_object_range(range_value: Column, kind: Column, is_class: Column | None = None) -> Column:
    """Whether a property's range is a class: by its declared kind, a URL or fragment, else by is_class."""
    value = F.coalesce(range_value, F.lit(""))
    low = F.lower(value)
    known = F.lit(False) if is_class is None else F.coalesce(is_class, F.lit(False))
    return F.when(kind == "object", True).when(kind == "datatype", False).when(value.startswith("http"), True).when(low.startswith("xsd:") | low.isin(*XSD), False).otherwise(value.contains("#") | known)


def cursor(sort_value: Column, key: Column) -> Column:
    return F.base64(F.to_json(F.struct(sort_value.alias("s"), key.alias("k"))).cast("binary"))


def rdf_format(filename: Column) -> Column:
    low = F.lower(filename)
    pick = F.lit("turtle")
    for ends, kind in ((".turtle", "turtle"), (".owl", "xml"), (".rdf", "xml"), (".xml", "xml"), (".jsonld", "json-ld"), (".json", "json-ld"), (".nt", "nt"), (".n3", "n3"), (".ttl", "turtle")):
        pick = F.when(low.endswith(ends), kind).otherwise(pick)
    return pick


def sniff_rdf(text: Column, hint: Column) -> Column:
    """Unambiguous first tokens (after a byte order mark, blanks and comments) before the hint."""
    head = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\uFEFF?\s*(#[^\n]*\n\s*)*", "")
    starts = lambda *marks: F.greatest(*[head.startswith(m) for m in marks], F.lit(False))
    return F.when(starts("<?xml", "<rdf:RDF", "<RDF"), "xml").when(starts("@prefix", "@base"), "turtle").when(head.startswith("{") & F.left(head, F.lit(1024)).contains("@context"), "json-ld").otherwise(hint)


def is_read_only(query: Column) -> Column:
    return ~query.rlike(r"(?i)\b(insert|update|replace|remove|delete|upsert|drop|create|alter|merge|truncate)\b")


def cross_check(quote: Column, evidence: Column) -> Column:
    return F.coalesce(evidence.contains(quote), F.lit(False)) & (F.trim(quote) != "")


def fenced(raw: Column) -> Column:
    """What stands inside a code fence at the beginning of a text, else the text."""
    text = F.trim(raw)
    inner = F.regexp_extract(text, r"(?s)^```[^\n]*\n(.*)```", 1)
    return F.when(F.startswith(text, F.lit("```")), F.trim(inner)).otherwise(text)


# fixed values: scores of a judge's ratings, and of ratings that are missing or unknown
RATINGS, UNRATED = {"EXPLICIT": 1.0, "INFERRED": 0.7, "PLAUSIBLE": 0.4, "HALLUCINATED": 0.1}, 0.5


def rating_score(rating: Column) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("double"))
    for name, score in RATINGS.items():
        out = out.when(F.upper(rating) == name, score)
    return out.otherwise(UNRATED)
