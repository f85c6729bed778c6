"""Word and PowerPoint files as sections, from their zipped XML.

Files come as rows of Spark's binaryFile source; each is parsed on its own, so no shuffle is needed.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: name spaces of office files
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"

Section = tuple[int | None, str, str, str]  # page, heading, body, notes


def docx_sections(content: bytes) -> Iterator[Section]:
    """Paragraphs in a heading style begin a section; a heading without body has none."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    heading, parts = "", []
    for p in body.findall(f"{_W}p"):
        text = "".join("\t" if x.tag == f"{_W}tab" else "\n" if x.tag == f"{_W}br" else x.text or "" for x in p.iter() if x.tag in (f"{_W}t", f"{_W}tab", f"{_W}br")).strip()
        style = p.find(f"{_W}pPr/{_W}pStyle")
        if not text:
            continue
        if style is not None and style.get(f"{_W}val", "").lower().startswith("heading"):
            if parts:
                yield None, heading, "\n".join(parts), ""
            heading, parts = text, []
        else:
            parts.append(text)
    if parts:
        yield None, heading, "\n".join(parts), ""


def _texts(element) -> str:
    """Text of a shape's or a cell's paragraphs."""
    return "\n".join("".join(t.text or "" for t in p.iter(f"{_A}t")) for p in element.iter(f"{_A}p")).strip()


def _kind(shape) -> str:
    found = shape.find(f"{_P}nvSpPr/{_P}nvPr/{_P}ph")
    return "" if found is None else found.get("type", "body")


def _related(z: zipfile.ZipFile, part: str, kind: str) -> list[str]:
    """Parts that a part refers to with a relationship of the kind."""
    folder, _, name = part.rpartition("/")
    rels = f"{folder}/_rels/{name}.rels"
    if rels not in z.namelist():
        return []
    out = []
    for r in ElementTree.fromstring(z.read(rels)):
        if r.get("Type", "").endswith(f"/{kind}"):
            path = [] if r.get("Target").startswith("/") else folder.split("/")
            for step in r.get("Target").strip("/").split("/"):
                path = path[:-1] if step == ".." else [*path, step]
            out.append((r.get("Id"), "/".join(path)))
    return out


def pptx_sections(content: bytes) -> Iterator[Section]:
    """A section for each slide with text: its title, the other shapes, table cells and groups in order, and its notes."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        deck = "ppt/presentation.xml"
        parts = dict(_related(z, deck, "slide"))
        order = [x.get(f"{_R}id") for x in ElementTree.fromstring(z.read(deck)).iter(f"{_P}sldId")]
        for number, slide in enumerate((parts[i] for i in order if i in parts), 1):
            tree = ElementTree.fromstring(z.read(slide))
            heading, body = "", []
            for shape in tree.iter():
                if shape.tag == f"{_P}sp":
                    text = _texts(shape)
                    if _kind(shape) in ("title", "ctrTitle") and not heading:
                        heading = text
                    elif text:
                        body.append(text)
                elif shape.tag == f"{_A}tr":
                    body.append("\t".join(_texts(cell) for cell in shape.findall(f"{_A}tc")))
            notes = ""
            for _, part in _related(z, slide, "notesSlide"):
                notes = "\n".join(_texts(s) for s in ElementTree.fromstring(z.read(part)).iter(f"{_P}sp") if _kind(s) == "body").strip()
            text = "\n".join(x for x in body if x.strip()).strip()
            if heading or text or notes:
                yield number, heading, text, notes


PARSERS = {"docx": docx_sections, "pptx": pptx_sections}


def office_sections(files: DataFrame) -> DataFrame:
    """path, form, section, page, heading, body, notes and error of binary files (path, content), by their name's ending.

    Sections count from 0 within a file.  A file that can't be read gives one row with an error and nothing else; files with
    other endings give none.
    """

    def parsed(path: str, form: str, content: bytes) -> Iterable[tuple]:
        try:
            return [(path, form, i, *row, None) for i, row in enumerate(PARSERS[form](content))]
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, AttributeError, TypeError) as error:
            return [(path, form, None, None, None, None, None, f"{type(error).__name__}: {error}")]

    def run(frames):
        for frame in frames:
            rows = [row for path, form, content in zip(frame["path"], frame["form"], frame["content"]) for row in parsed(path, form, content)]
            yield pd.DataFrame(rows, columns=["path", "form", "section", "page", "heading", "body", "notes", "error"]).astype({"section": "Int32", "page": "Int32"})

    own = files.select("path", F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1)).alias("form"), "content").where(F.col("form").isin(*PARSERS))
    return own.mapInPandas(run, "path string, form string, section int, page int, heading string, body string, notes string, error string")
