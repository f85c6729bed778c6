"""Turtle: syntax, broken files, round trips."""

import random

from loamgraph.sources import rdf, turtle

DOC = """@prefix : <http://e/#> . @prefix x-1: <http://x/> .
BASE <http://b/dir/>
PREFIX owl: <http://www.w3.org/2002/07/owl#>
# a comment . with ; marks
:a a owl:Class ; x-1:p "one"@en-GB , 'two', "3"^^<http://t> ;; x-1:q 1, -2.5, 1e3, .5, true, +7 ; .
<rel#x> x-1:p <../up>, <http://abs/é>, _:b.1 .
_:b.1 x-1:p [ x-1:q :c.d ; x-1:r [] ], ( 1 ( :z ) "s" ) , () .
[ x-1:only "blank" ] .
[] x-1:p :e\\,f, :g%20h .
:long x-1:p \"\"\"a "quoted" ""text""
next \\u00e9 \\t line\"\"\", '''it's''', "" .
:last x-1:p false.
"""


def triples(text, **given):
    return [tuple(t) for t in turtle.Reader(text, **given).triples()]


def test_syntax():
    got = triples(DOC)
    o = lambda s, p: [t[2:] for t in got if t[0] == s and t[1] == f"http://x/{p}"]
    assert ("http://e/#a", rdf.RDF + "type", rdf.OWL + "Class", "iri", None, None) in got
    assert o("http://e/#a", "p") == [("one", "literal", None, "en-GB"), ("two", "literal", None, None), ("3", "literal", "http://t", None)]
    assert [(x[0], x[2].rpartition("#")[2]) for x in o("http://e/#a", "q")] == [("1", "integer"), ("-2.5", "decimal"), ("1e3", "double"), (".5", "decimal"), ("true", "boolean"), ("+7", "integer")]
    assert [x[0] for x in o("http://b/dir/rel#x", "p")] == ["http://b/up", "http://abs/é", "_:b.1"]
    nested, items, empty = (x[0] for x in o("_:b.1", "p"))
    assert empty == rdf.RDF + "nil" and o(nested, "q") == [("http://e/#c.d", "iri", None, None)] and o(nested, "r")[0][1] == "blank"
    first, rest = ({t[0]: t[2] for t in got if t[1] == rdf.RDF + k} for k in ("first", "rest"))
    assert first[items] == "1" and first[first[rest[items]]] == "http://e/#z" and first[rest[rest[items]]] == "s" and rest[rest[rest[items]]] == empty
    assert [t[2] for t in got if t[1] == "http://x/only"] == ["blank"]
    assert {"http://e/#e,f", "http://e/#g%20h"} <= {t[2] for t in got}
    assert [x[0] for x in o("http://e/#long", "p")] == ['a "quoted" ""text""\nnext é \t line', "it's", ""]
    assert o("http://e/#last", "p")[0][0] == "false"


def test_broken_texts_tell_where(spark, tmp_path):
    good = "@prefix : <http://e/> . :a :p :b . "
    texts = {"ok": good, "prefix": good + "\n:c no:p :d .", "open": good + ":a :p ( :b", "dot": good + ":a :p :b", "char": good + "\n\n:a :p ^ .", "bytes": None, "empty": "", "deep": good + ":a :p " + "[ :p " * 3000}
    for name, text in texts.items():
        (tmp_path / f"{name}.ttl").write_bytes(b"\xff\xfe\x00" if text is None else text.encode())
    rows = turtle.read_turtle(spark, str(tmp_path)).collect()
    by = {name: [r for r in rows if r.path.endswith(f"/{name}.ttl")] for name in texts}
    assert {name: sum(r.error is None for r in x) for name, x in by.items()} == {name: 0 if name in ("bytes", "empty") else 1 for name in texts}
    assert {name for name, x in by.items() if any(r.error for r in x)} == set(texts) - {"ok", "empty"}
    assert "line 3" in by["char"][-1].error and "'no'" in by["prefix"][-1].error


def test_blank_nodes_of_files_stay_apart(spark, tmp_path):
    for name in "xy":
        (tmp_path / f"{name}.ttl").write_text("_:n <http://p> [] , [] .")
    rows = turtle.read_turtle(spark, str(tmp_path)).collect()
    assert len({r.s for r in rows}) == 2 and len({r.o for r in rows}) == 4
    assert {r.s for r in turtle.read_turtle(spark, str(tmp_path), scoped=False).collect()} == {"_:n"}


def test_round_trip_over_many_files(spark, tmp_path):
    r = random.Random(2)
    pick = lambda *x: r.choice(x)
    rows = set()
    for i in range(400):
        s = pick(f"http://e/{i % 50}", f"_:b{i % 9}", rdf.OWL + "Thing", "http://e/odd name<>", "urn:x:y#z")
        kind = pick("iri", "literal", "blank")
        o = {"iri": pick("http://e/v", rdf.XSD + "int", rdf.OWL + "a.b", "http://e/#-"), "blank": f"_:b{i % 7}", "literal": pick('a "b"', "x\\y\n\tz\r", "", "é 🙂", "'''", f"{i}")}[kind]
        datatype, lang = pick((None, None), (rdf.XSD + "integer", None), ("http://t/ü", None), (None, "en-GB")) if kind == "literal" else (None, None)
        rows.add((s, pick("http://p/q", rdf.RDF + "type", rdf.RDFS + "label"), o, kind, datatype, lang))
    df = spark.createDataFrame(sorted(rows, key=str), "s string, p string, o string, kind string, datatype string, lang string")
    turtle.write_turtle(df.repartition(5), str(tmp_path / "out"), {"e": "http://e/"})
    back = turtle.read_turtle(spark, str(tmp_path / "out"), scoped=False)
    assert back.where("error IS NOT NULL").count() == 0
    assert sorted((tuple(x)[:6] for x in back.collect()), key=str) == sorted(rows, key=str)
    assert turtle.to_turtle(df.limit(0)).where("value NOT LIKE '@prefix%'").count() == 0
