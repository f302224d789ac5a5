"""Lake tables that grow by commits: what a batch adds to all of them is seen at once or not at all, and readers hold one snapshot."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "number long, writer string, batch long, tables array<string>, at timestamp"


def _rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(f"{schema}, commit long").parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{schema}, commit long")


def log(spark: SparkSession, base: str) -> DataFrame:
    """The manifest: a row for each commit (number, writer, batch, tables, at)."""
    return _rows(spark, f"{base}/commits", LOG).drop("commit")


def last_commit(spark: SparkSession, base: str) -> int:
    """The number of the newest commit; 0 before the first."""
    return log(spark, base).agg(F.coalesce(F.max("number"), F.lit(0))).first()[0]


def snapshot(spark: SparkSession, base: str, name: str, schema: str, as_of: int | None = None) -> DataFrame:
    """A table as it was after commit as_of (the newest without one). Rows of commits that are not finished are never seen: their folders
    are pruned, since commits are numbered in order and a number is given once the one before is in the log."""
    last = last_commit(spark, base) if as_of is None else as_of
    return _rows(spark, f"{base}/{name}", schema).filter(F.col("commit") <= last).drop("commit")


def is_committed(spark: SparkSession, base: str, writer: str, batch: int) -> bool:
    return not log(spark, base).filter((F.col("writer") == writer) & (F.col("batch") == batch)).isEmpty()


def commit(spark: SparkSession, base: str, writer: str, batch: int, tables: dict[str, DataFrame]) -> bool:
    """Add rows to tables as one commit; False if the writer's batch is in the log already, so that a batch can run again.

    Each table's rows go to a folder of their own (commit=<number>) that nobody reads yet; the commit is the row in the log, one file that
    Spark's committer moves into place at the end. If a writer fails before that, the snapshot stays as it was, and
    the next try writes over what was left behind. One writer at a time; readers need not wait. Tables are kept for long, so they are packed by zstd.
    """
    if is_committed(spark, base, writer, batch):
        return False
    number = last_commit(spark, base) + 1
    for name, rows in tables.items():
        rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{base}/{name}/commit={number}")
    entry = spark.createDataFrame([(number, writer, batch, sorted(tables), datetime.now(UTC))], LOG)
    entry.coalesce(1).write.mode("overwrite").parquet(f"{base}/commits/commit={number}")
    return True
