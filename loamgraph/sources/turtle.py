"""Turtle files as triples, and triples as Turtle.

Files are independent, so each is read by one task (`binaryFile`: whole, up to 2 GB); what goes on is a row for each triple.
A file that is no Turtle gives one row with its error and the triples before it, and doesn't stop the others.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .rdf import OWL, RDF, RDFS, SH, XSD

PREFIXES = {"rdf": RDF, "rdfs": RDFS, "owl": OWL, "xsd": XSD, "sh": SH}
COLUMNS = "s string, p string, o string, kind string, datatype string, lang string, path string, error string"

_TOKEN = re.compile(
    r"""(?P<space>[ \t\r\n]+|\#[^\r\n]*)
    |(?P<iri><(?:[^\x00-\x20<>"{}|^`\\]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*>)
    |(?P<text>\"{3}(?:\"{0,2}(?:[^"\\]|\\.))*\"{3}|'{3}(?:'{0,2}(?:[^'\\]|\\.))*'{3}|"(?:[^"\\\r\n]|\\.)*"|'(?:[^'\\\r\n]|\\.)*')
    |(?P<at>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<type>\^\^)
    |(?P<blank>_:\w(?:[\w.\-]*[\w\-])?)
    |(?P<number>[+-]?(?:(?:\d+\.\d*|\.?\d+)[eE][+-]?\d+|\d*\.\d+|\d+))
    |(?P<name>(?:[^\W\d_](?:[\w.\-]*[\w\-])?)?:(?:[\w\-:]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%]|\.(?=[.\w\-:%\\]))*)
    |(?P<word>[A-Za-z]+)
    |(?P<mark>[.;,\[\]()])""",
    re.VERBOSE | re.DOTALL,
)
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.DOTALL)
_CHARS = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f"}


def _plain(text: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _CHARS.get(m[3], m[3]), text) if "\\" in text else text


class Reader:
    """Triples of one text, in order; scope tells its blank nodes from those of other texts."""

    def __init__(self, text: str, scope: str = "", base: str = ""):
        self.text, self.scope, self.base, self.prefixes, self.fresh, self.out = text, scope, base, {}, 0, []
        self.tokens = self._tokens()
        self.kind = self.value = None
        self._next()

    def _tokens(self) -> Iterator[tuple[str, str]]:
        at = 0
        while at < len(self.text):
            m = _TOKEN.match(self.text, at)
            if not m:
                raise ValueError(f"unexpected {self.text[at : at + 20]!r} in line {self.text.count(chr(10), 0, at) + 1}")
            if m.lastgroup != "space":
                yield m.lastgroup, m.group()
            at = m.end()

    def _next(self) -> None:
        self.kind, self.value = next(self.tokens, (None, None))

    def _take(self, value: str) -> None:
        if self.value != value:
            raise ValueError(f"{value!r} expected, not {self.value!r}")
        self._next()

    def _blank(self, name: str | None = None) -> str:
        if name is None:
            self.fresh += 1
            name = f"anon{self.fresh}"
        return f"_:{self.scope}{name}"

    def _iri(self) -> str:
        kind, value = self.kind, self.value
        self._next()
        if kind == "iri":
            own = _plain(value[1:-1])
            return own if re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:", own) else urljoin(self.base, own) if self.base else own
        if kind == "name":
            prefix, _, local = value.partition(":")
            if prefix not in self.prefixes:
                raise ValueError(f"unknown prefix {prefix!r}")
            return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)
        raise ValueError(f"a name expected, not {value!r}")

    def triples(self) -> Iterator[tuple]:
        while self.kind:
            if self.value in ("@prefix", "@base") or (self.kind == "word" and self.value.upper() in ("PREFIX", "BASE")):
                self._directive()
            else:
                brackets = self.value == "["
                subject, _ = self._node()
                if not (brackets and self.value == "."):
                    self._pairs(subject)
                self._take(".")
            yield from self.out
            self.out = []

    def _directive(self) -> None:
        dotted, name = self.value.startswith("@"), self.value.lstrip("@").lower()
        self._next()
        if name == "prefix":
            prefix = self.value
            if self.kind != "name" or not prefix.endswith(":"):
                raise ValueError(f"a prefix expected, not {prefix!r}")
            self._next()
            self.prefixes[prefix[:-1]] = self._iri()
        else:
            self.base = self._iri()
        if dotted:
            self._take(".")

    def _node(self) -> tuple[str, str]:
        """A subject or object that is no literal, and its kind."""
        if self.value == "[":
            self._next()
            own = self._blank()
            if self.value != "]":
                self._pairs(own)
            self._take("]")
            return own, "blank"
        if self.value == "(":
            self._next()
            items = []
            while self.value != ")":
                if self.kind is None:
                    raise ValueError("a list is not closed")
                items.append(self._object())
            self._next()
            cells = [(self._blank(), "blank") for _ in items] + [(RDF + "nil", "iri")]
            for i, item in enumerate(items):
                self.out.append((cells[i][0], RDF + "first", *item))
                self.out.append((cells[i][0], RDF + "rest", *cells[i + 1], None, None))
            return cells[0]
        if self.kind == "blank":
            own = self._blank(self.value[2:])
            self._next()
            return own, "blank"
        return self._iri(), "iri"

    def _object(self) -> tuple:
        """o, kind, datatype and lang."""
        kind, value = self.kind, self.value
        if kind == "text":
            self._next()
            quotes = 3 if value[:3] in ('"""', "'''") and len(value) >= 6 else 1
            text, datatype, lang = _plain(value[quotes:-quotes]), None, None
            if self.kind == "at":
                lang = self.value[1:]
                self._next()
            elif self.kind == "type":
                self._next()
                datatype = self._iri()
            return text, "literal", datatype, lang
        if kind == "number":
            self._next()
            return value, "literal", XSD + ("double" if "e" in value.lower() else "decimal" if "." in value else "integer"), None
        if kind == "word" and value in ("true", "false"):
            self._next()
            return value, "literal", XSD + "boolean", None
        return *self._node(), None, None

    def _pairs(self, subject: str) -> None:
        while True:
            if self.kind == "word" and self.value == "a":
                self._next()
                verb = RDF + "type"
            else:
                verb = self._iri()
            while True:
                self.out.append((subject, verb, *self._object()))
                if self.value != ",":
                    break
                self._next()
            if self.value != ";":
                return
            while self.value == ";":
                self._next()
            if self.value in (".", "]", None):
                return


def parse_turtle(files: DataFrame, scoped: bool = True, base: str = "") -> DataFrame:
    """Triples of binary files (path, content) with their path; a row with error ends the triples of a broken file.

    scoped: blank nodes are told apart by file; else one name means one node in all files, as in a folder of `write_turtle`.
    """

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                scope = f"f{hashlib.sha256(path.encode()).hexdigest()[:12]}_" if scoped else ""
                rows = []
                try:
                    for row in Reader((content or b"").decode("utf-8-sig"), scope, base).triples():
                        rows.append((*row, path, None))
                        if len(rows) >= 50_000:
                            yield _batch(rows)
                            rows = []
                except (ValueError, RecursionError) as error:
                    rows.append((None, None, None, None, None, None, path, str(error) or type(error).__name__))
                if rows:
                    yield _batch(rows)

    return files.select("path", "content").mapInArrow(run, COLUMNS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*rows)], names)


def read_turtle(spark: SparkSession, path: str, scoped: bool = True, base: str = "") -> DataFrame:
    return parse_turtle(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path), scoped, base)


def to_turtle(triples: DataFrame, prefixes: dict[str, str] | None = None) -> DataFrame:
    """Lines of Turtle: every task's lines are a text of its own, with its prefixes; a subject's triples come together.

    Rows are sorted by subject and written as they pass, so no task holds the triples of a subject.
    """
    known = PREFIXES | (prefixes or {})
    local = re.compile(r"[A-Za-z_][A-Za-z0-9_\-]*")

    def name(iri: str) -> str:
        for prefix, space in known.items():
            if iri.startswith(space) and local.fullmatch(iri, len(space)):
                return f"{prefix}:{iri[len(space) :]}"
        bad = re.sub(r"[\x00-\x20<>\"{}|^`\\]", lambda m: f"\\u{ord(m[0]):04X}", iri)
        return f"<{bad}>"

    def node(value: str) -> str:
        return value if value.startswith("_:") else name(value)

    def text(value: str) -> str:
        return '"' + value.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t") + '"'

    def run(batches):
        last, lines = None, [f"@prefix {prefix}: <{space}> ." for prefix, space in known.items()]
        for batch in batches:
            for s, p, o, kind, datatype, lang in zip(*(batch.column(c).to_pylist() for c in ("s", "p", "o", "kind", "datatype", "lang"))):
                value = text(o) + (f"@{lang}" if lang else f"^^{name(datatype)}" if datatype else "") if kind == "literal" else node(o)
                verb = "a" if p == RDF + "type" else name(p)
                if s == last:
                    lines.append(f"    ; {verb} {value}")
                else:
                    if last is not None:
                        lines.append("    .")
                    lines.append(f"{node(s)} {verb} {value}")
                    last = s
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
            lines = []
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array(["    ."], pa.string())], ["value"])

    own = triples.where("s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL").select("s", "p", "o", "kind", "datatype", "lang")
    return own.repartition("s").sortWithinPartitions("s", "p", "o").mapInArrow(run, "value string")


def write_turtle(triples: DataFrame, path: str, prefixes: dict[str, str] | None = None) -> None:
    """A folder of Turtle files; blank nodes keep their names over all of them."""
    to_turtle(triples, prefixes).write.mode("overwrite").text(path)
