"""Lists of a document's names: work in proportion to their length."""

import time

from pyspark.sql import functions as F

from millrace.operators import graph
from millrace.plans import testbed


def test_relationships_of_a_long_document(spark, tmp_path):
    rows = [(1, " ".join("Name" + "abcdefgh"[i % 8] for i in range(40_000)), "en", "a"), (2, "One Word", "en", "a"), (3, "Alone", "en", "a"), (4, "none", "en", "a"), (5, None, "en", "a"), (6, "With That Name", "en", "a")]
    spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    made = testbed.entities(spark, str(tmp_path))
    few = {r.doc_id: r.relationships for r in made.filter("doc_id IN (2, 4, 5, 6)").collect()}
    assert [tuple(x) for x in few[6]] == [("With", "That", "part-of", 0.1, "r1"), ("That", "Name", "works with", 0.2, "r2")] and few[2] == few[4] == few[5] == []
    start = time.time()
    got = graph.relationship_lookup(made, "namea", 5).select("doc_id", "source", "target", F.col("confidence")).collect()
    assert [(r.doc_id, r.confidence) for r in got] == [(1, 0.9)] * 5
    assert time.time() - start < 60
