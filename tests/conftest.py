import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="spark-"))
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="spark-")).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def duck(small):
    import duckdb

    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for table in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
    return connection


def plain(frame):
    """Rows of a pandas frame as sorted tuples of text, columns by name."""
    import numpy as np
    import pandas as pd

    def one(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "null"
        if isinstance(v, (float, np.floating)):  # pandas makes whole numbers floats where some are null
            return str(int(v)) if float(v).is_integer() else repr(round(float(v), 9))
        return str(v)

    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(one, row)) for row in frame.itertuples(index=False, name=None))


@pytest.fixture(scope="session")
def same_as_sql(spark, small, duck):
    def check(query, sql):
        ours, theirs = query(spark, small).toPandas(), duck.execute(sql).df()
        assert sorted(ours.columns) == sorted(theirs.columns)
        assert plain(ours) == plain(theirs)

    return check
