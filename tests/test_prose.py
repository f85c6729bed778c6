"""The prose chunker on odd texts and repeated ids, against its SQL."""

import duckdb
import pandas as pd

from loamgraph.operators import chunking as C
from loamgraph.plans import catalog  # noqa: F401  registers all queries
from loamgraph.plans import registry

TEXTS = ["", "   ", "\n\n \t\n", None, "one", "a\n\nb\n \nc", "\n\n".join([" ".join(["w"] * 300)] * 3), "a b c d　 e\u0085f g\x0bh\x1ci j", " ", " ".join(["x"] * 512), " ".join(["x"] * 513) + "\r\n\f"]


def test_query_equals_sql(spark, tmp_path):
    docs = pd.DataFrame({"doc_id": [*range(len(TEXTS)), 4, 4, 9, 10, 0], "text": [*TEXTS, "one", "other words", TEXTS[9], TEXTS[9], ""]})  # ids repeat
    docs["lang"], docs["source"], docs["n_chars"] = "en", "s", 1
    docs.to_parquet(tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    got = sorted((tuple(r) for r in registry.QUERIES["prose_chunker"](spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(con.execute(registry.ORACLES["prose_chunker"]).fetchall(), key=str) and len(got) == len(docs)


def test_documents_without_words_have_no_chunk_by_default(spark):
    docs = spark.createDataFrame([(1, ""), (2, None), (3, "a b")], "doc_id long, text string")
    assert [(r.doc_id, r.chunk_index, r.text, r.token_count) for r in C.chunk_documents(docs).collect()] == [(3, 0, "a b", 2)]
    assert sorted((r.doc_id, r.text, r.token_count) for r in C.chunk_documents(docs, empty=True).collect()) == [(1, "", 0), (2, None, None), (3, "a b", 2)]
