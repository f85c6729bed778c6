"""The postings index against full scans."""

import random

import pytest
from pyspark.sql import functions as F

from loamgraph.operators import chunking, text_index

BOOSTS = {"label": 2.0, "text": 1.0}


def columns():
    return {f: F.col(f) for f in BOOSTS}


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(4)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(900):
        text = " ".join(r.choices(words, [1 / (k + 1) for k in range(200)], k=r.randint(1, 60)))
        rows.append((i, f"Label {r.choice(words)}, {r.choice(words)}", f"{text}; W3-x the" if i % 9 else f"{text} rare{i % 27} the the"))
    rows += [(5, "label w3", "the w3"), (5, "label w3", "the w3"), (None, "w3", "w3 the"), (901, None, None), (902, "", " .. ")]
    return spark.createDataFrame(rows, "id long, label string, text string").cache()


@pytest.fixture(scope="module")
def index(spark, docs, tmp_path_factory):
    path, text_index.CHUNK = str(tmp_path_factory.mktemp("index")), 32
    text_index.build(docs, path, "id", columns())
    text_index.CHUNK = 1024
    return path


def scan(docs, words):
    return sorted(((r.id, round(r.score, 9)) for r in chunking.bm25(docs, words, "id", {f: (F.col(f), b) for f, b in BOOSTS.items()}).collect()), key=lambda x: (-x[1], x[0] is not None, x[0] or 0))


@pytest.mark.parametrize("words", [["w3"], ["the", "w3", "label"], ["rare0", "w150", "nowhere"], ["nowhere"]])
def test_all_hits_equal_a_scan(spark, docs, index, words):
    got = text_index.search(spark, index, words, BOOSTS).collect()
    assert sorted(((r.id, round(r.score, 9)) for r in got), key=str) == sorted(scan(docs, words), key=str)


@pytest.mark.parametrize("k", [1, 7, 40, 5000])
def test_the_best_equal_a_scan(spark, docs, index, k):
    for words in (["rare0", "w199"], ["the", "w3"], ["w60", "w61", "the"]):
        got = [(r.rank, r.id, round(r.score, 9)) for r in text_index.search(spark, index, words, BOOSTS, k).orderBy("rank").collect()]
        expected = scan(docs, words)[:k]
        assert [x[0] for x in got] == list(range(1, len(expected) + 1))
        assert [x[2] for x in got] == [x[1] for x in expected]
        assert {x[1] for x in got if x[2] > expected[-1][1]} == {x[0] for x in expected if x[1] > expected[-1][1]}


def test_only_blocks_that_can_matter_are_read(spark, index, monkeypatch):
    read = []
    real = text_index._scores
    monkeypatch.setattr(text_index, "_scores", lambda blocks: read.append(blocks) or real(blocks))
    text_index.search(spark, index, ["w199", "the"], BOOSTS, 3).collect()
    whole = text_index._blocks(spark, index, ["the", "w199"], text_index._words(spark, index, ["the", "w199"], BOOSTS))
    assert 0 < sum(x.count() for x in read) < 0.7 * whole.count() < spark.read.parquet(f"{index}/blocks").count() / 10
    plan = whole.select("chunk", "top")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [part#" in plan and "postings:" not in plan and "top:double" in plan


def test_blocks_are_bounded(spark, docs, index):
    blocks = spark.read.parquet(f"{index}/blocks")
    assert blocks.agg(F.max("n")).head()[0] < 4 * 32 and blocks.where("word = 'the'").count() > 10


def test_no_documents(spark, docs, tmp_path):
    text_index.build(docs.limit(0), str(tmp_path), "id", columns())
    assert text_index.search(spark, str(tmp_path), ["the"], BOOSTS).count() == 0
    assert text_index.search(spark, str(tmp_path), ["the"], BOOSTS, 3).count() == 0
