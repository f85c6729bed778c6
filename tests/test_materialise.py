"""Targets recovered by the text of a link, against brute force, and by how many pairs."""

import random
import re

from pyspark.sql import functions as F

from loamgraph.operators import materialise as M


def spaced(text):
    return f" {re.sub('[^a-z0-9]+', ' ', text.lower())} "


def brute(links, classes):
    out = []
    for i, owner, target, text in links:
        named = [(-len(label), key) for key, _, label in classes if key != owner and spaced(label) in spaced(text)]
        out.append((i, target, min(named)[1] if named else None))
    return sorted(out, key=str)


def test_text_tier_equals_brute_force(spark):
    r = random.Random(5)
    labels = ["red gear", "Red Gear box", "blue bolt", "ring", "bolt-on ring"]
    classes = [(f"k{i % 30}", f"urn:x#k{i % 30}", r.choice(labels)) for i in range(45)]  # labels with many keys, keys with several labels
    texts = ["the red gear box, a ring", "Made for RED GEAR.", "bolt on ring", "rings only", "blue bolt; red gear"]
    # a link's id repeats with another target and text
    links = [(i // 2, f"k{r.randrange(30)}", f"?{i}", r.choice(texts)) for i in range(120)]
    got = M.resolve_targets(spark.createDataFrame(links, "id long, owner string, target string, text string"), spark.createDataFrame(classes, "key string, uri string, label string"))
    assert sorted(((x.id, x.target, x.class_key) for x in got.collect()), key=str) == brute(links, classes)


def test_equal_texts_and_labels_meet_once(spark):
    classes = spark.range(5000).select(F.col("id").alias("key"), F.lit("").alias("uri"), F.when(F.col("id") % 2 == 0, "red gear").otherwise("red gear box").alias("label"))
    texts = spark.createDataFrame([("a red gear box",), ("red gear",)], "text string")
    assert sorted((r.text, r.n, r["keys"]) for r in M.named_labels(texts, classes).collect()) == [("a red gear box", -12, [1, 3]), ("a red gear box", -8, [0, 2]), ("red gear", -8, [0, 2])]
    links = spark.range(2000).select("id", (F.col("id") % 4).alias("owner"), F.lit("?").alias("target"), F.lit("A red gear box").alias("text"))
    rows = M.resolve_targets(links, classes).groupBy("owner", "class_key").count().collect()
    assert sorted(tuple(r) for r in rows) == [(0, 1, 500), (1, 3, 500), (2, 1, 500), (3, 1, 500)]
