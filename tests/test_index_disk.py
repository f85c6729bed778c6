"""What building the postings index leaves on disk, and its results whatever the partitions."""

import os
import random

import pytest
from pyspark.sql import functions as F

from loamgraph.operators import chunking, text_index


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(8)
    words = [f"word{i}" for i in range(3000)]
    rows = [(f"d{i % 2900}", " ".join(r.choices(words, k=r.randint(0, 120)))) for i in range(3000)]  # ids repeat
    return spark.createDataFrame(rows, "id string, text string").repartition(7, "id").cache()


def test_texts_are_not_copied(spark, docs, tmp_path):
    kept = spark.sparkContext._jsc.sc().getCheckpointDir().get() if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined() else spark.conf.get("spark.checkpoint.dir")
    size = lambda top: sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(top.removeprefix("file:")) for f in names)
    before, texts = size(kept), docs.agg(F.sum(F.length("text"))).head()[0]
    text_index.build(docs, str(tmp_path), "id", {"text": F.col("text")})
    assert size(kept) - before < 0.1 * texts


@pytest.mark.parametrize("parts", [1, 40])
def test_partitions_do_not_matter(spark, docs, tmp_path, parts):
    # 40 partitions of which many are empty
    own = docs.repartitionByRange(parts, F.when(F.col("id") < "d2", "a").otherwise(F.col("id")))
    text_index.build(own, str(tmp_path), "id", {"text": F.col("text")})
    expected = sorted(((x.id, round(x.score, 9)) for x in chunking.bm25(docs, ["word3", "word70"], "id", {"text": (F.col("text"), 1.0)}).collect()), key=lambda x: (-x[1], x[0]))
    got = text_index.search(spark, str(tmp_path), ["word3", "word70"], {"text": 1.0}).collect()
    assert sorted(((x.id, round(x.score, 9)) for x in got), key=lambda x: (-x[1], x[0])) == expected
    best = text_index.search(spark, str(tmp_path), ["word3", "word70"], {"text": 1.0}, 9).orderBy("rank").collect()
    assert [round(x.score, 9) for x in best] == [x[1] for x in expected[:9]] and spark.read.parquet(f"{tmp_path}/blocks").where("word IS NULL").agg(F.sum("n")).head()[0] == 3000
