"""Documents without text, or with nothing but white space, through queries with an oracle."""

import shutil
from pathlib import Path

import duckdb
import pytest
from conftest import plain

from millrace.operators import versions
from millrace.plans import ORACLES, QUERIES

BLANK = [None, "", " ", "\n", " " * 250, " " * 201 + "the end", "the first\nthe last"]


@pytest.fixture(scope="module")
def blanks(spark, small, tmp_path_factory):
    """A folder whose documents are the small ones' first, and each odd text under 60 ids, so that every remainder that the queries look at has it."""
    folder = tmp_path_factory.mktemp("blank")
    for file in Path(small).iterdir():
        if file.name != "documents.parquet":
            shutil.copytree(file, folder / file.name) if file.is_dir() else shutil.copy(file, folder / file.name)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    odd = [(1000 + 60 * i + k, text, "en", "News", len(text or "")) for i, text in enumerate(BLANK) for k in range(60)]
    docs.filter("doc_id < 60").unionByName(spark.createDataFrame(odd, docs.schema)).coalesce(1).write.parquet(str(folder / "documents.parquet"))
    return str(folder)


@pytest.mark.parametrize("name", ["diff_log", "normalize_entities", "delta_metadata", "merge_people_into_entities"])
def test_blank_texts_equal_sql(name, spark, blanks):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{blanks}/documents.parquet/*.parquet'")
    assert plain(QUERIES[name](spark, blanks).toPandas()) == plain(connection.execute(ORACLES[name]).df())


def test_an_earlier_version_without_text_is_one(spark):
    """A body that was null before is a reprocessing; a document that no chunk speaks of has no row."""
    delta = spark.createDataFrame([(1, 0, 0, 2, 0, 1.0, False), (2, 0, 0, 1, 0, 1.0, False)], "doc_id long, unchanged long, modified long, added long, removed long, change_ratio double, no_changes boolean")
    before = spark.createDataFrame([(1, None), (3, " ")], "doc_id long, body string")
    after = spark.createDataFrame([(1, "new"), (2, "first"), (3, "  "), (4, "")], "doc_id long, body string")
    got = {r.doc_id: (r.diff_type, r.change_ratio) for r in versions.diff_log(delta, before, after).collect()}
    assert got == {1: ("reprocessing", 1.0), 2: ("initial_processing", None)}
