"""Lookups through an index of files: the rows of a full scan, from few files."""

from pyspark.sql import functions as F

from millrace.sources import skipping as X


def test_lookups_open_few_files(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = spark.range(2000).select("id", F.concat(F.lit("k"), (F.col("id") * 7919) % 2000).alias("key"), F.when(F.col("id") % 5 > 0, F.col("id") % 40).alias("few"))
    X.write_clustered(rows, path, "id", 10)
    index = X.index_files(spark, path, ["id", "key", "few"]).cache()
    assert index.count() == 30
    for key, values, most in (("id", [3, 1999, 5000], 2), ("id", [-1], 0), ("key", ["k5", "k77", "none"], 4), ("few", [7, None], 10), ("id", [], 0)):
        found = X.lookup(spark, path, index, key, values)
        asked = [v for v in values if v is not None]
        want = sorted(map(str, rows.filter(F.col(key).isin(asked)).collect())) if asked else []
        assert sorted(map(str, found.collect())) == want
        assert len(found.inputFiles()) <= most or not want
    late = spark.createDataFrame([(9000, "k5", 1)], "id long, key string, few long")
    late.write.mode("append").parquet(path)  # a file that the index does not know
    assert {r.id for r in X.lookup(spark, path, index, "key", ["k5"]).collect()} == {9000, *(r.id for r in rows.filter("key = 'k5'").collect())}
