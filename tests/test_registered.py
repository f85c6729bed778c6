"""Table functions and the aggregate, called from SQL."""

import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from loamgraph.functions import registered, scores  # noqa: F401
from loamgraph.operators import chunking


@pytest.fixture(scope="module")
def docs(spark):
    registered.register(spark)
    r = random.Random(1)
    text = lambda: "\n\n".join(" ".join("w" * r.randint(1, 4) for _ in range(r.randint(1, 40))) for _ in range(r.randint(0, 9)))
    df = spark.createDataFrame([(i, f"g{i % 4}", text() if i % 7 else None, i % 5) for i in range(60)], "doc_id long, grp string, text string, size int").cache()
    df.createOrReplaceTempView("some_docs")
    return df


def test_chunks_equal_the_operator(spark, docs):
    for most, overlap in ((512, 0), (20, 6), (7, 100)):
        got = spark.sql(f"SELECT * FROM chunk_texts(TABLE(some_docs), max_tokens => {most}, overlap => {overlap})")
        assert got.columns == ["doc_id", "grp", "size", "chunk_index", "text", "token_count"]
        expected = chunking.chunk_documents(docs, most, overlap).select("doc_id", "chunk_index", "text", "token_count")
        assert sorted(map(tuple, got.select(*expected.columns).collect())) == sorted(map(tuple, expected.collect()))
    other = spark.sql("SELECT * FROM chunk_texts(TABLE(SELECT grp, text AS body FROM some_docs), text_col => 'body')")
    assert other.columns == ["grp", "chunk_index", "body", "token_count"] and other.count() > 40


def test_batches_equal_the_operator(spark, docs):
    got = spark.sql("SELECT * FROM token_batches(TABLE(some_docs), group_col => 'grp', order_col => 'doc_id', size_col => 'size', budget => 9, most => 4)")
    expected = chunking.batches_by_budget(docs, "grp", ["doc_id"], F.col("size"), 9, 4)
    assert sorted((r.doc_id, r.batch) for r in got.collect()) == sorted((r.doc_id, r.batch) for r in expected.collect())


@pytest.mark.parametrize("call", ["chunk_texts(TABLE(some_docs), max_tokens => 0)", "chunk_texts(TABLE(some_docs), text_col => 'nowhere')", "chunk_texts(TABLE(some_docs), max_tokens => 'x')", "token_batches(TABLE(some_docs), group_col => 'grp', order_col => 'none', size_col => 'size')"])
def test_wrong_arguments_fail_before_the_query_runs(spark, docs, call):
    with pytest.raises(AnalysisException):
        spark.sql(f"SELECT * FROM {call}")


def test_calibration_gap(spark, docs):
    rows = [("a", 0.95, 1.0), ("a", 0.91, 0.0), ("a", 0.15, 0.0), ("b", 1.0, 1.0), ("c", None, 1.0)]
    spark.createDataFrame(rows, "g string, c double, r double").createOrReplaceTempView("judged")
    got = {r.g: r.e for r in spark.sql("SELECT g, round(calibration_gap(c, r), 6) AS e FROM judged GROUP BY g").collect()}
    assert got["a"] == round((2 * abs(0.93 - 0.5) + 0.15) / 3, 6) and got["b"] == 0.0 and got["c"] is None
