"""What steps of the pipeline give the driver to plan and to hold."""

from loamgraph.llm import near_dups, secrets

WORDS = [f"word{i}" for i in range(4000)]


def jobs_of(spark, name, f):
    """Spark jobs that f runs, and its result."""
    sc = spark.sparkContext
    sc.setJobGroup(name, name)
    try:
        out = f()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    return len(sc.statusTracker().getJobIdsForGroup(name)), out


def test_near_duplicates_plan_no_rounds_over_nothing(spark):
    texts = [" ".join(WORDS[40 * i : 40 * i + 40]) for i in range(30)]
    docs = spark.createDataFrame([*enumerate(texts), (30, texts[3] + " more"), (31, None)], "doc_id long, text string")
    n, rows = jobs_of(spark, "apart", lambda: near_dups.near_duplicates(docs, 5).collect())
    assert {r.doc_id: r.component_id for r in rows} == {i: 3 if i == 30 else i for i in range(32)}
    assert n < 90


def test_near_duplicates_of_large_nodes_plan_blocks_and_tiles_once(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "LIMIT", 20)
    texts = [" ".join(WORDS[:30] + WORDS[100 + 20 * i : 120 + 20 * i]) for i in range(100)]
    docs = spark.createDataFrame([*enumerate(texts), (100, texts[7] + " more")], "doc_id long, text string")
    sizes = []
    made = near_dups.cut

    def cut(df):
        sizes.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))
        return made(df)

    monkeypatch.setattr(near_dups, "cut", cut)
    rows = near_dups.near_duplicates(docs, 5).collect()
    assert {r.doc_id: r.component_id for r in rows} == {i: 7 if i == 100 else i for i in range(101)}
    assert max(sizes) < 20


def test_a_plan_holds_the_vocabulary_table_once(spark):
    found = spark.createDataFrame([("hunter2hunter2hun", "a b", "x", "", "c", "app")], "value string, before string, word string, word_prefix string, after string, path string")
    bits = ",".join(str(1_000_000 + i) for i in range(secrets._BITS // 32))
    plan = secrets.features(found, bits).select("covered")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("1000777") == 1
