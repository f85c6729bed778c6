"""Hand-computed values and properties of the engine's operators."""

import importlib
import subprocess
import sys

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loamgraph.functions import scores as S
from loamgraph.functions import text as X
from loamgraph.operators import chunking, graph, resolve, versioned
from loamgraph.operators.components import connected_components
from loamgraph.sources import rdf
from loamgraph.streaming import limits


def value(spark, column):
    return spark.range(1).select(column.alias("v")).head()[0]


def test_jaro_winkler_values():
    assert S.jaro_winkler_pair("Account", "account") == 1.0
    assert S.jaro_winkler_pair("", "a") == 0.0 and S.jaro_winkler_pair(None, None) == 0.0
    assert S.jaro_winkler_pair("martha", "marhta") == pytest.approx(0.9611, abs=1e-3)
    assert S.jaro_winkler_pair("customer", "customers") > S.jaro_winkler_pair("customer", "supplier")


@given(st.text(max_size=12), st.text(max_size=12))
@settings(max_examples=200, deadline=None)
def test_jaro_winkler_stays_in_range(a, b):
    assert 0.0 <= S.jaro_winkler_pair(a, b) <= 1.0 + 1e-12
    if a:
        assert S.jaro_winkler_pair(a, a) == 1.0


def test_similarities(spark):
    lit = F.lit
    assert value(spark, X.token_overlap(lit("a b c"), lit("b c d"))) == 0.5
    assert value(spark, X.token_overlap(lit(""), lit("b"))) == 0
    vec = lambda *x: F.array(*[lit(float(v)) for v in x])
    assert value(spark, X.cosine(vec(1, 2), vec(1, 2))) == pytest.approx(1)
    assert value(spark, X.cosine(vec(1, 0), vec(-1, 0))) == 0
    assert value(spark, X.cosine(vec(1, 0), vec(1, 0, 0))) == 0
    assert value(spark, X.cosine_or_null(vec(0, 0), vec(1, 0))) is None
    assert value(spark, S.blend({"a": (lit(1.0), 0.4), "b": (lit(None).cast("double"), 0.2), "c": (lit(0.5), 0.4)})) == pytest.approx(0.75)


def test_confidence_arithmetic(spark):
    day = 86400.0
    assert value(spark, S.evidence_age_score(F.lit(90 * day))) == pytest.approx(0.5)
    assert value(spark, S.evidence_age_score(F.lit(180 * day))) == pytest.approx(0.25)
    assert value(spark, S.evidence_age_score(F.lit(-1.0))) == 1.0 and value(spark, S.evidence_age_score(F.lit(None).cast("double"))) == 1.0
    assert sum(S.CONFIDENCE_WEIGHTS.values()) == pytest.approx(1) and sum(S.HEALTH_WEIGHTS.values()) == pytest.approx(1)
    assert value(spark, S.decayed(F.lit(0.04), F.lit(1e9))) == 0.04
    assert value(spark, S.clamp(F.lit(None).cast("double"))) is None


def versions(spark):
    rows = [(1, 7, 1, 1.0, 2.0, "a"), (2, 7, 2, 2.0, 5.0, "b"), (3, 7, 3, 5.0, None, "c"), (4, 8, 1, 3.0, 4.0, "x")]
    return spark.createDataFrame(rows, "key long, uri long, version int, created double, expired double, label string")


def test_as_of_is_half_open(spark):
    keys = lambda t: sorted(r.key for r in versioned.as_of(versions(spark), F.lit(t)).collect())
    assert keys(0.5) == [] and keys(1.0) == [1] and keys(2.0) == [2] and keys(3.5) == [2, 4] and keys(9.0) == [3]
    assert [r.key for r in versioned.history(versions(spark), 1).collect()] == [3, 2, 1]


def test_diff_of_a_table_with_itself_is_empty(spark):
    v = versions(spark)
    assert versioned.temporal_diff(v, F.lit(2.0), F.lit(2.0), "uri", ["label"]).count() == 0
    found = {r.uri: r.change for r in versioned.temporal_diff(v, F.lit(1.5), F.lit(3.5), "uri", ["label"]).collect()}
    assert found == {7: "changed", 8: "added"}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_do_not_depend_on_edge_order(spark, seed):
    import random

    r = random.Random(seed)
    edges = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(45)]
    root = list(range(61))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    for order in (edges, [(b, a) for a, b in reversed(edges)]):
        got = {x.node: x.component for x in connected_components(spark.createDataFrame(order, "src long, dst long")).collect()}
        assert got == {n: find(n) for e in edges if e[0] != e[1] for n in e}


def test_graph_on_cycles_and_chains(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(6)], "src long, dst long")
    loop = chain.union(spark.createDataFrame([(3, 1)], "src long, dst long"))
    assert {r.node: r.depth for r in graph.closure(chain, [2], 3).collect()} == {2: 0, 3: 1, 4: 2, 5: 3}
    assert graph.cycle_nodes(chain).count() == 0
    assert {r.node for r in graph.scc(loop).collect()} == {1, 2, 3}
    assert [r.cycle for r in graph.core_cycles(loop).collect()] == [[1, 2, 3]]
    assert graph.depths(chain).where("node = 0").head().depth == 6


def edges_of(spark, rows):
    return spark.createDataFrame(rows, "a long, b long, confidence double")


def repaired(spark, rows, conflicts):
    kept, gone = resolve.repair(edges_of(spark, rows), spark.createDataFrame(conflicts, "x long, y long"))
    return sorted((r.a, r.b) for r in kept.collect()), sorted((r.a, r.b, r.confidence, r.x, r.y) for r in gone.collect())


def test_repair_drops_the_weakest_edge_of_a_connecting_path(spark):
    assert repaired(spark, [(1, 2, 0.9), (2, 3, 0.4), (3, 4, 0.8)], [(1, 4)]) == ([(1, 2), (3, 4)], [(2, 3, 0.4, 1, 4)])
    # a weaker edge off the path resolves nothing and stays
    assert repaired(spark, [(1, 2, 0.9), (2, 3, 0.6), (2, 9, 0.1)], [(3, 1)]) == ([(1, 2), (2, 9)], [(2, 3, 0.6, 1, 3)])
    # equal confidence: the smallest edge goes; two components are repaired side by side
    assert repaired(spark, [(1, 2, 0.5), (2, 3, 0.5), (11, 12, 0.8), (12, 13, None)], [(1, 3), (11, 13)]) == ([(2, 3), (11, 12)], [(1, 2, 0.5, 1, 3), (12, 13, 0.0, 11, 13)])
    # coherent: nothing to do
    assert repaired(spark, [(1, 2, 0.5), (3, 4, 0.5)], [(1, 3), (2, 2)]) == ([(1, 2), (3, 4)], [])
    # a second way between the two is cut too
    kept, gone = repaired(spark, [(1, 2, 0.3), (2, 4, 0.9), (1, 3, 0.2), (3, 5, 0.9), (5, 4, 0.9)], [(1, 4)])
    assert [g[:2] for g in gone] == [(1, 2), (1, 3)] and len(kept) == 3
    report = resolve.coherence_report(edges_of(spark, [(1, 2, 0.9), (3, 2, 0.6)]), spark.createDataFrame([(1, 3)], "x long, y long")).head()
    assert (report.coherent, report.disjoint_axioms, report.removed_count, report.kept_count) == (False, 1, 1, 1)


def test_repair_leaves_no_conflict(spark):
    import random

    r = random.Random(2)
    rows = list({(a, b): (a, b, r.random()) for a, b in ((r.randint(0, 40), r.randint(41, 80)) for _ in range(90))}.values())
    conflicts = [(r.randint(0, 20), r.randint(21, 40)) for _ in range(12)]
    kept, gone = repaired(spark, rows, conflicts)
    assert len(kept) + len(gone) == len(rows)
    reach = {n: {n} for n in range(81)}
    for a, b in kept:
        both = reach[a] | reach[b]
        for n in both:
            reach[n] = both
    assert not [c for c in conflicts if c[1] in reach[c[0]]]


def test_greedy_match(spark):
    pairs = spark.createDataFrame([(1, 10, 0.9), (1, 11, 0.8), (2, 10, 0.85), (2, 11, 0.1)], "a long, b long, score double")
    assert sorted((r.a, r.b) for r in resolve.greedy_match(pairs).collect()) == [(1, 10), (2, 11)]


def test_scored_join_equals_all_pairs(spark):
    import random

    r = random.Random(5)
    words = [f"w{i}" for i in range(25)]
    text = lambda n: " ".join(r.choice(words) for _ in range(r.randint(0, n)))
    rows = [(i, text(5), text(8)) for i in range(120)] + [(200, "the w1", None), (201, "the w1", None), (202, None, None)]
    table = spark.createDataFrame(rows, "key long, label string, description string")

    def overlap(x, y):
        x, y = set((x or "").split()), set((y or "").split())
        return len(x & y) / max(1, len(x | y))

    score = {(a[0], b[0]): 0.6 * overlap(a[1], b[1]) + 0.4 * overlap(a[2], b[2]) for a in rows for b in rows if a[0] < b[0]}
    for least in (0.3, 0.55, 0.6):
        got = {(x.a, x.b): x.score for x in resolve.scored_join(table, None, least - 1e-9).collect()}
        assert got == pytest.approx({k: v for k, v in score.items() if v >= least - 1e-9})
    left, right = table.where("key % 2 = 0"), table.where("key % 2 = 1")
    got = {(min(x.a, x.b), max(x.a, x.b)) for x in resolve.scored_join(left, right, 0.4).collect()}
    assert got == {k for k, v in score.items() if v >= 0.4 and (k[0] + k[1]) % 2}


def test_rescored_touches_only_changed_pairs(spark):
    rows = [(1, "a b c", "x"), (2, "a b c", "x"), (3, "a b d", "x"), (4, "q r", "x")]
    schema = "key long, label string, description string"
    before = resolve.scored_join(spark.createDataFrame(rows, schema), None, 0.5)
    after = spark.createDataFrame([(1, "q r", "x"), *rows[1:]], schema)
    changed = spark.createDataFrame([(1,)], "key long")
    got = sorted((x.a, x.b, round(x.score, 6)) for x in resolve.rescored(before, changed, after, 0.5).collect())
    assert got == sorted((x.a, x.b, round(x.score, 6)) for x in resolve.scored_join(after, None, 0.5).collect())
    # a pair that is not touched keeps the score that it had
    stale = before.withColumn("score", F.when(F.col("a") == 2, 0.123).otherwise(F.col("score")))
    assert {(x.a, x.b): x.score for x in resolve.rescored(stale, changed, after, 0.5).collect()}[2, 3] == 0.123


def test_components_of_long_cycles(spark):
    ring = [(i, (i + 1) % 70) for i in range(70)] + [(100, 0), (69, 101), (102, 102), (103, 104)]
    got = {r.node: r.component for r in graph.scc(spark.createDataFrame(ring, "src long, dst long")).collect()}
    assert got == {**{i: 0 for i in range(70)}, 102: 102}


def test_components_equal_mutual_reachability(spark):
    import random

    r = random.Random(3)
    edges = [(r.randint(0, 30), r.randint(0, 30)) for _ in range(45)]
    reach = {(a, b) for a, b in edges}
    for k in range(31):
        reach |= {(a, b) for a in range(31) for b in range(31) if (a, k) in reach and (k, b) in reach}
    expected = {a: min(b for b in range(31) if (a, b) in reach and (b, a) in reach) for a in range(31) if (a, a) in reach}
    got = {x.node: x.component for x in graph.scc(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == expected


def test_shortest_paths_and_lists_have_no_cap(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(30)], "src long, dst long")
    assert len(graph.shortest_paths(chain, 0).where("node = 30").head().path) == 31
    triples = [(f"_:{i}", rdf.RDF + "first", f"x{i}", "iri", None, None) for i in range(12)] + [(f"_:{i}", rdf.RDF + "rest", f"_:{i + 1}" if i < 5 else rdf.RDF + "nil" if i == 5 else f"_:{6 + (i - 5) % 6}", "blank", None, None) for i in range(12)]
    own = spark.createDataFrame(triples, "s string, p string, o string, kind string, datatype string, lang string")
    heads = spark.createDataFrame([("_:0",), ("_:6",)], "head string")
    assert [(x.head, x.item) for x in rdf.rdf_list(own, heads).orderBy("position").collect()] == [("_:0", f"x{i}") for i in range(6)]


def test_imports_dag_directions(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (4, 2), (5, 6)], "src long, dst long")
    names = spark.createDataFrame([(i, f"N{9 - i}") for i in range(1, 7)], "node long, name string")
    show = lambda *x: [(r.src, r.dst) for r in graph.imports_dag(edges, names, *x)[1].collect()]
    assert show() == [(1, 2), (2, 3), (4, 2), (5, 6)]
    assert show(2, "outbound") == [(2, 3)] and show(2, "inbound") == [(1, 2), (4, 2)] and show(1, "both", 1) == [(1, 2)] and show(1, "outbound", -5) == [(1, 2)]
    assert [r.node for r in graph.imports_dag(edges, names, 2, "both")[0].collect()] == [4, 3, 2, 1]
    with pytest.raises(ValueError):
        graph.imports_dag(edges, names, 2, "sideways")


ENTITY = "key long, label string, evidence array<string>, confidence double, last_evidenced_at double, version long, created double, expired double"
REQUEST = "nth long, doc string, entity long, action string, evidence array<string>, confidence_after double, new_label string, src long, dst long"


def test_supersede_dispatch(spark):
    from loamgraph.operators.revise import supersede

    entities = spark.createDataFrame([(1, "a", ["e"], 0.5, None, 1, 1.0, None), (2, "b", None, 0.5, None, 1, 1.0, None), (3, "c", [], 0.5, None, 3, 1.0, 2.0), (4, "d", [], 0.5, None, 1, 1.0, None)], ENTITY)
    edges = spark.createDataFrame([(1, 2, 1.0, None), (2, 4, 1.0, 3.0), (4, 4, 1.0, None)], "src long, dst long, created double, expired double")
    requests = [
        (1, "d1", 1, "REINFORCE", ["q1", "q2"], 0.7, None, None, None),
        (2, "d1", 1, "REINFORCE", ["again"], 0.9, None, None, None),
        (3, "d2", 1, "REINFORCE", ["q3"], None, None, None, None),
        (4, "d1", 2, "REVISE", [], None, "b2", None, None),
        (5, "d2", 2, "RETRACT", [], None, None, None, None),
        (6, "d1", 3, "REVISE", [], None, "c2", None, None),
        (7, "d1", 4, "REVISE", [], None, None, None, None),
        (8, "d3", 4, "RETRACT", [], None, None, None, None),
        (9, "d1", 9, "GAP_FILL", [], None, None, 1, 4),
        (10, "d2", 9, "GAP_FILL", [], None, None, 1, None),
        (11, "d1", 4, "FLAG_FOR_CURATION", [], None, None, None, None),
        (12, "d0", 4, "FLAG_FOR_CURATION", [], None, None, None, None),
        (13, "d1", 4, "EXPLODE", [], None, None, None, None),
    ]
    log = spark.createDataFrame([("d0", 4, "FLAG_FOR_CURATION")], "doc string, entity long, action string")
    out = supersede(entities, edges, spark.createDataFrame(requests, REQUEST), log, 10.0, 100)
    audit = {r.nth: (r.status, r.reason, r.old_version, r.new_version) for r in out.audit.collect()}
    assert audit == {
        1: ("applied", None, None, 1), 2: ("skipped", "repeated", None, None), 3: ("applied", None, None, 1), 4: ("applied", None, 2, 102), 5: ("failed", "no live version", None, None), 6: ("failed", "no live version", None, None),
        7: ("failed", "no payload", None, None), 8: ("applied", None, 4, None), 9: ("applied", None, None, None), 10: ("failed", "no edge", None, None), 11: ("applied", None, None, None), 12: ("skipped", "repeated", None, None), 13: ("failed", "unknown action", None, None),
    }
    found = {(r.key, r.version): (r.label, r.evidence, r.confidence, r.last_evidenced_at, r.expired) for r in out.entities.collect()}
    assert found == {(1, 1): ("a", ["e", "q1", "q2", "q3"], 0.7, 10.0, None), (2, 1): ("b", None, 0.5, None, 10.0), (102, 2): ("b2", None, 0.5, None, None), (3, 3): ("c", [], 0.5, None, 2.0), (4, 1): ("d", [], 0.5, None, 10.0)}
    assert sorted((r.src, r.dst, r.expired) for r in out.edges.collect() if r.expired) == [(1, 2, 10.0), (2, 4, 3.0)]
    assert sorted((r.src, r.dst) for r in out.edges.collect() if not r.expired) == [(1, 4), (1, 102), (4, 4)]
    again = supersede(out.entities, out.edges, spark.createDataFrame(requests, REQUEST), out.audit.where("status = 'applied'").unionByName(log, allowMissingColumns=True), 20.0, 1000)
    assert not again.audit.where("status = 'applied'").count()


SECTION = "doc_id long, form string, section int, page int, heading string, body string, notes string"


def test_sections_and_slides_are_chunked_apart(spark):
    long = " ".join(f"w{i}" for i in range(25))
    rows = [(1, "docx", 0, None, "Intro", "one two\n\nthree four five\n\nsix", "told aside"), (1, "docx", 1, 3, "Next", long, None), (1, "docx", 2, 4, None, "  ", None), (2, "PPTX", 1, 1, "Plan", "a b", "say this"), (2, "pptx", 2, 2, "Plan (cont'd)", long, None), (2, "pptx", 3, 3, "Plan 2", "", None), (2, "pptx", 4, 4, "End", "bye", None)]
    got = chunking.chunk_sections(spark.createDataFrame(rows, SECTION), 6, 3).orderBy("doc_id", "chunk_index").collect()
    own = [(r.doc_id, r.chunk_index, r.section, r.role, r.part, r.parts, r.topic_unit, r.text) for r in got]
    words = long.split()
    runs = [" ".join(words[i : i + 6]) for i in range(0, 25, 6)]
    assert [x[7] for x in own if x[0] == 1] == ["Intro\n\none two\n\nthree four five", "three four five\n\nsix\n[Notes] told aside", "Next", *runs]
    assert [x[1] for x in own if x[0] == 1] == list(range(8)) and {x[3] for x in own if x[0] == 1} == {"body"}
    slides = [x[2:] for x in own if x[0] == 2]
    assert slides[0] == (1, "slide", None, None, 1, "Plan\n\na b") and slides[1] == (1, "notes", None, None, 1, "say this")
    assert slides[2] == (2, "slide", 1, 6, 1, "Plan (cont'd)") and [s[5] for s in slides[3:8]] == runs and slides[7][2:4] == (6, 6)
    assert slides[8] == (3, "slide", None, None, 1, "Plan 2") and slides[9] == (4, "slide", None, None, 2, "End\n\nbye")
    assert chunking.chunk_sections(spark.createDataFrame([], SECTION)).count() == 0


def test_batches_carry_over_sorted_rows(spark):
    rows = [("a", i, 40) for i in range(7)] + [("b", 0, 500), ("b", 1, 1), (None, 0, None)]
    got = chunking.batches_by_budget(spark.createDataFrame(rows, "g string, i long, n long"), "g", ["i"], F.col("n"), 100, 3)
    assert {(r.g, r.i): r.batch for r in got.collect()} == {**{("a", i): i // 2 for i in range(7)}, ("b", 0): 0, ("b", 1): 1, (None, 0): 0}


def test_links_resolve_by_tiers(spark):
    from loamgraph.operators.materialise import resolve_targets

    classes = spark.createDataFrame([("k1", "http://x#Car", "Car"), ("k2", "http://x#SteamEngine", "Steam engine"), ("k3", "http://x#Engine", "Engine")], "key string, uri string, label string")
    links = [(1, "k3", "http://x#Car", None), (2, "k3", "other/Car", None), (3, "k3", "steam ENGINE ", None), (4, "k1", "?", "pulled by a steam-engine, not an engine"), (5, "k3", "?", "the engineer"), (6, "k3", "?", "An engine."), (7, "k1", None, None)]
    got = {r.id: (r.class_key, r.tier) for r in resolve_targets(spark.createDataFrame(links, "id long, owner string, target string, text string"), classes).collect()}
    assert got == {1: ("k1", "uri"), 2: ("k1", "fragment"), 3: ("k2", "label"), 4: ("k2", "text"), 5: (None, "miss"), 6: (None, "miss"), 7: (None, "miss")}

def office_file(parts):
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return bytearray(out.getvalue())


def test_office_files_are_read_as_sections(spark):
    from loamgraph.sources.office import office_sections

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    para = lambda text, style="": f"<w:p>{f'<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>' if style else ''}<w:r><w:t>{text}</w:t></w:r></w:p>"
    docx = office_file({"word/document.xml": f"<w:document {w}><w:body>{para('before')}{para('One', 'Heading1')}{para('a')}{para('  ')}{para('b')}{para('Two', 'Heading2')}{para('Three', 'heading 1')}{para('c')}</w:body></w:document>"})
    ns = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    shape = lambda text, kind="": f"<p:sp><p:nvSpPr><p:nvPr>{f'<p:ph type={chr(34)}{kind}{chr(34)}/>' if kind else ''}</p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>"
    cell = lambda text: f"<a:tc><a:txBody><a:p><a:r><a:t>{text}</a:t></a:r></a:p></a:txBody></a:tc>"
    rel = lambda i, kind, target: f'<Relationship Id="{i}" Type="http://x/{kind}" Target="{target}"/>'
    pptx = office_file({
        "ppt/presentation.xml": f'<p:presentation {ns}><p:sldIdLst><p:sldId r:id="r2"/><p:sldId r:id="r1"/><p:sldId r:id="r3"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": f"<Relationships>{rel('r1', 'slide', 'slides/s1.xml')}{rel('r2', 'slide', 'slides/s2.xml')}{rel('r3', 'slide', '/ppt/slides/s3.xml')}</Relationships>",
        "ppt/slides/s1.xml": f"<p:sld {ns}>{shape('body')}<p:grpSp>{shape('in a group')}</p:grpSp><a:tbl><a:tr>{cell('x')}{cell('y')}</a:tr></a:tbl></p:sld>",
        "ppt/slides/s2.xml": f"<p:sld {ns}>{shape('Plan', 'title')}{shape('text', 'body')}</p:sld>",
        "ppt/slides/_rels/s2.xml.rels": f"<Relationships>{rel('n', 'notesSlide', '../notes/n1.xml')}</Relationships>",
        "ppt/notes/n1.xml": f"<p:notes {ns}>{shape('7', 'sldNum')}{shape('say it', 'body')}</p:notes>",
        "ppt/slides/s3.xml": f"<p:sld {ns}>{shape('  ')}</p:sld>",
    })
    files = spark.createDataFrame([("x/a.docx", docx), ("b.PPTX", pptx), ("c.docx", bytearray(b"no zip")), ("d.txt", bytearray(b"x"))], "path string, content binary")
    got = sorted((r.path, -1 if r.section is None else r.section, r.page, r.heading, r.body, r.notes, bool(r.error)) for r in office_sections(files).collect())
    assert got == [
        ("b.PPTX", 0, 1, "Plan", "text", "say it", False), ("b.PPTX", 1, 2, "", "body\nin a group\nx\ty", "", False), ("c.docx", -1, None, None, None, None, True),
        ("x/a.docx", 0, None, "", "before", "", False), ("x/a.docx", 1, None, "One", "a\nb", "", False), ("x/a.docx", 2, None, "Three", "c", "", False),
    ]
    chunks = chunking.chunk_sections(office_sections(files).where("error IS NULL").withColumn("doc_id", F.xxhash64("path")), 50, 0)
    assert chunks.where("role = 'notes'").count() == 1 and chunks.count() == 6


@given(st.lists(st.integers(1, 12), max_size=30), st.integers(12, 20), st.integers(0, 10))
@settings(max_examples=200, deadline=None)
def test_packing_covers_everything_within_the_budget(sizes, budget, overlap):
    runs = chunking.pack(sizes, budget, overlap)
    covered, last = set(), 0
    for a, b in runs:
        assert a < b and sum(sizes[max(a, last) : b]) <= budget and sum(sizes[a : max(a, last)]) <= overlap
        last = b
        covered.update(range(a, b))
    assert covered == set(range(len(sizes)))


def test_markdown_sections(spark):
    text = "intro\n# One\nbody\nmore\n## Two\n\nlast"
    got = [(r.section, r.heading, r.body) for r in chunking.markdown_sections(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("section").collect()]
    assert got == [(0, None, "intro"), (1, "One", "body\nmore"), (2, "Two", "last")]


def test_ntriples_round_trip(spark):
    rows = [("u:a", rdf.RDFS + "label", 'x "y"\nz\\', "literal", None, "en"), ("u:a", "u:p", "_:b1", "blank", None, None), ("_:b1", "u:n", "3", "literal", rdf.XSD + "integer", None)]
    own = spark.createDataFrame(rows, "s string, p string, o string, kind string, datatype string, lang string")
    assert sorted(map(str, rdf.parse_ntriples(rdf.to_ntriples(own)).collect())) == sorted(map(str, own.collect()))


def test_anchored_limiter_in_batch_and_stream(spark, tmp_path):
    rows = [("a", float(t)) for t in (0, 10, 59, 60, 61, 200)] + [("b", 5.0)]
    events = spark.createDataFrame(rows, "key string, at double")
    batch = sorted((r.key, r.at, r.allowed) for r in limits.anchored_limit(events, "key", "at", 60, 2).collect())
    assert batch == [("a", 0.0, True), ("a", 10.0, True), ("a", 59.0, False), ("a", 60.0, True), ("a", 61.0, True), ("a", 200.0, True), ("b", 5.0, True)]
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    out = limits.run_to_table(spark, limits.anchored_limit_stream(stream, "key", "at", 60, 2), "anchored", str(tmp_path / "state"))
    assert sorted((r.key, r.at, r.allowed) for r in out.collect()) == batch


def test_entry_imports_without_the_optional_parts():
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("loamgraph.llm"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert len(e.queries()) > 200 and "pipeline" not in e.queries() and not any(q.startswith("op1_") for q in e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=importlib.import_module("__spark_entry__").__file__.rpartition("/")[0])
