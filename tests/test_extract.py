"""The extractor by rule against the same rule in Python, and the individuals made of its mentions."""

import re

import pytest

from loamgraph.operators import extract

WORD, SENTENCE = re.compile(r"\b([A-Z][a-zA-Z][a-zA-Z0-9_-]+)\b"), re.compile(r"[^.!?]+[.!?]")
TEXTS = [
    "Alice knows Bob. Alice owns Car-7, and Bob: Uses, Tool! He is Ann. Ann is",
    "École Été NASA is Big-Org; Foo-bar- has A1x. É_Foo éFoo Fooé Al Bo Z9z",
    "",
    None,
    "Alice  knows\nBob. alice knows Bob. Alice knows Bob? No end is Here",
    "Dog contains Dog. Cat has, Dog.",
]


def by_rule(text, types, verbs):
    labels = list(dict.fromkeys(m.group(1) for m in WORD.finditer(text or "")))
    triples = set()
    for sentence in SENTENCE.findall(text or ""):
        tokens = sentence.strip().split()
        for i, token in enumerate(tokens):
            verb = token.lower().rstrip(",;:")
            if verb in verbs and 0 < i < len(tokens) - 1:
                head, tail = tokens[i - 1].rstrip(",;:"), tokens[i + 1].rstrip(".,;:!?")
                if WORD.match(head) and WORD.match(tail):
                    triples.add((head, verb, tail))
    return [(k, x, types.get(x, "")) for k, x in enumerate(labels)], triples


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame([(("o1", "o2")[i % 2], i // 2, i % 2, x) for i, x in enumerate(TEXTS)], "ontology string, doc_id long, chunk_id int, text string")


def test_words_equal_the_rule(spark, chunks):
    types = {"Alice": "Person", "Bob": "person", "Dog": "Animal"}
    mentions, relations = extract.words(types)(chunks)
    got = {}
    for r in mentions.collect():
        got.setdefault((r.doc_id, r.chunk_id), []).append((r.nth, r.label, r.type))
    said = {}
    for r in relations.collect():
        said.setdefault((r.doc_id, r.chunk_id), set()).add((r.head, r.relation, r.tail))
    for i, text in enumerate(TEXTS):
        labels, triples = by_rule(text, types, set(extract.VERBS))
        assert sorted(got.get((i // 2, i % 2), [])) == labels
        assert said.get((i // 2, i % 2), set()) == triples
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id", "0 AS chunk_id", "text")
    found = {(r.doc_id, r.label) for r in extract.words()(documents)[0].collect()}
    assert found == {(r.doc_id, x) for r in documents.collect() for _, x, _ in by_rule(r.text, {}, ())[0]}


def test_individuals_are_one_for_a_class_and_label(spark, chunks):
    classes = spark.createDataFrame([("o1", 5, "Person"), ("o1", 3, "PERSON"), ("o1", 9, "animal"), ("o2", 7, "Animal")], "ontology string, key long, label string")
    mentions = spark.createDataFrame([(0, 0, 0, "Alice", "Person"), (0, 0, 1, " bob ", "person"), (2, 0, 0, "ALICE", "Person"), (2, 0, 1, "alice", "animal"), (2, 0, 2, "Nobody", "nothing"), (2, 0, 3, " ", "Person"), (2, 1, 0, "dog", "Animal"), (2, 1, 1, "Ghost", "Animal")], "doc_id long, chunk_id int, nth int, label string, type string")
    relations = spark.createDataFrame([(0, 0, "alice", "knows", "BOB"), (2, 0, "Alice", "knows", "bob"), (2, 1, "Dog", "contains", "dog"), (2, 1, "Dog", "sees", "Ghost"), (2, 1, "Dog", " ", "dog")], "doc_id long, chunk_id int, head string, relation string, tail string")
    made, said = extract.individuals(chunks, mentions, relations, classes)
    rows = sorted((r.ontology, r.class_key, r.label, r.doc_id, r.chunk_id, r.start, r.end) for r in made.collect())
    assert rows[:3] == [("o1", "3", "Alice", 0, 0, 0, 5), ("o1", "3", "bob", 0, 0, 12, 15), ("o1", "9", "alice", 2, 0, 0, 5)]
    assert rows[3:] == [("o2", "7", "Ghost", 2, 1, None, None), ("o2", "7", "dog", 2, 1, 0, 3)]
    key = {(r.class_key, r.label): r.key for r in made.collect()}
    got = {(r.src, r.predicate, r.dst): r.span for r in said.collect()}
    assert set(got) == {(key["3", "Alice"], "knows", key["3", "bob"]), (key["7", "dog"], "contains", key["7", "dog"]), (key["7", "dog"], "sees", key["7", "Ghost"])}
    assert tuple(got[key["3", "Alice"], "knows", key["3", "bob"]]) == (0, 15)
    loose, _ = extract.individuals(chunks, mentions, relations, classes, guided=False)
    assert {(r.class_key, r.label) for r in loose.collect()} == set(key) | {("", "Nobody")}
    assert extract.individuals(chunks.limit(0), mentions, relations, classes)[0].count() == 0
