"""Uploads as they come: extraction, chunks, versions, deltas, reuse and audit, a commit for each batch."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.functions.text import title_from_filename
from millrace.operators.chunking import chunk_blocks
from millrace.operators.versions import chunk_delta, delta_metadata, diff_log, reuse_chunk_work
from millrace.sources.commits import commit, is_committed, snapshot
from millrace.sources.extract import extract
from millrace.sources.shared import discard, written

#: The tables of the lake: a row for each version of a file, never changed.
TABLES = {
    "files": "file_id long, version int, sha256 string, filename string, content_type string",
    "documents": "file_id long, version int, adapter string, title string, body string",
    "chunks": "file_id long, version int, chunk_index int, content string, source_locator string, token_count int, content_hash string, work string, reused boolean",
    "deltas": "file_id long, version int, unchanged long, modified long, added long, removed long, change_ratio double, no_changes boolean, reclassify boolean",
    "diffs": "file_id long, version int, diff_type string, before_text string, after_text string, justification string, change_ratio double",
}


def read_lake(spark: SparkSession, base: str, name: str, as_of: int | None = None) -> DataFrame:
    """All versions in a snapshot."""
    return snapshot(spark, base, name, TABLES[name], as_of)


def read_current(spark: SparkSession, base: str, name: str, as_of: int | None = None) -> DataFrame:
    """The rows of each file's newest version in a snapshot."""
    newest = read_lake(spark, base, "files", as_of).groupBy("file_id").agg(F.max("version").alias("version"))
    return read_lake(spark, base, name, as_of).join(newest, ["file_id", "version"], "left_semi")


def _taken(spark: SparkSession, base: str, hashed: DataFrame) -> DataFrame:
    """What is to be processed of a batch: file_id, sha256, version, and n, how often it comes."""
    files = read_lake(spark, base, "files")
    first = hashed.groupBy("sha256", "file_id").agg(F.count(F.lit(1)).alias("n")).groupBy("sha256").agg(F.min(F.struct("file_id", "n")).alias("f")).select("sha256", "f.*")
    new = first.join(files.select("sha256"), "sha256", "left_anti").groupBy("file_id").agg(F.max(F.struct("sha256", "n")).alias("s")).select("file_id", "s.*")
    held = files.groupBy("file_id").agg(F.max("version").alias("version"))
    return new.join(held, "file_id", "left").select("file_id", "sha256", (F.coalesce("version", F.lit(0)) + 1).cast("int").alias("version"), "n")


def summary_work(content: Column) -> Column:
    """The work on a chunk where no model is at hand: its first 150 characters."""
    return F.substring(content, 1, 150)


def upload_batch(
    uploads: DataFrame, base: str, writer: str, number: int, chunker: Callable[[DataFrame], DataFrame] | None = None, work: Callable[[Column], Column] = summary_work,
    threshold: float = 0.85, reclassify: float = 0.20, adapters: dict[str, Callable[[Any, str], list]] | None = None,
) -> bool:
    """Process one batch of uploads (file_id, filename, content_type, content) into the lake at base, as one commit; False if it was committed before.

    Content that is registered already, or that comes twice in the batch, is not taken again (the smallest file id keeps it); empty content and null
    ids are not taken; of several contents of one file in a batch the last by hash is. A file that the lake has gets a further version: its chunks are
    compared with those of its newest version (chunk_delta), counts and what follows from them go to deltas, the change to diffs, and chunks
    whose text is unchanged keep the work done on them; only the others are worked on. A first upload is a version 1 with its diff row.
    All tables are one commit, so a batch that dies in between leaves the snapshot before it, and running it again is safe.
    chunker makes chunks (file_id, chunk_index, content, source_locator, token_count, content_hash) of extracted files (file_id, blocks).
    """
    spark = uploads.sparkSession
    if is_committed(spark, base, writer, number):
        return False
    raw = uploads.select(F.col("file_id").cast("long").alias("file_id"), "filename", "content_type", F.col("content").cast("binary").alias("content"))
    hashed = raw.filter(F.col("file_id").isNotNull() & (F.octet_length("content") > 0)).withColumn("sha256", F.sha2("content", 256))
    taken = written(_taken(spark, base, hashed.select("file_id", "sha256")), "taken")
    # contents meet what is taken of them here and nowhere else: from here on a row holds all that is known of its file
    texts = hashed.join(taken.filter("n = 1"), ["file_id", "sha256"])
    if not taken.filter("n > 1").isEmpty():
        texts = texts.unionByName(hashed.join(taken.filter("n > 1"), ["file_id", "sha256"]).dropDuplicates(["file_id"]))
    file = F.struct("file_id", "version", "sha256", "filename", "content_type").alias("file")
    extracted = written(extract(texts.select(file, "content", "filename", "content_type"), adapters, id="file").select("file.*", "adapter", "blocks"), "extracted", compression="zstd")

    body = F.array_join(F.transform(F.coalesce("blocks", F.array().cast(extracted.schema["blocks"].dataType)), lambda b: b["content"]), "\n\n")
    documents = extracted.select("file_id", "version", "adapter", title_from_filename(F.col("filename")).alias("title"), body.alias("body"))
    cut = chunker or (lambda rows: chunk_blocks(rows, id="file_id"))
    new = cut(extracted.filter("version = 1").select("file_id", "blocks"))
    chunks = new.withColumns({"version": F.lit(1), "work": work(F.col("content")), "reused": F.lit(False)})
    why = {"diff_type": F.lit("initial_processing"), "before_text": F.lit(None).cast("string"), "after_text": F.col("body"), "justification": F.lit("Initial processing"), "change_ratio": F.lit(None).cast("double")}
    rows = {"files": extracted, "documents": documents, "chunks": chunks, "deltas": spark.createDataFrame([], TABLES["deltas"]), "diffs": documents.filter("version = 1").withColumns(why)}
    used = [taken, extracted]
    if not taken.filter("version > 1").isEmpty():
        more, kept = _further(base, taken, extracted, documents, cut, work, threshold, reclassify)
        rows |= {name: rows[name].select(*more[name].columns).unionByName(more[name]) for name in ("chunks", "diffs")} | {"deltas": more["deltas"]}
        used += kept
    names = {name: [c.split(" ")[0] for c in schema.split(", ")] for name, schema in TABLES.items()}
    out = commit(spark, base, writer, number, {name: df.select(*names[name]) for name, df in rows.items()})
    discard(*used)
    return out


def _further(
    base: str, taken: DataFrame, extracted: DataFrame, documents: DataFrame, cut: Callable[[DataFrame], DataFrame], work: Callable[[Column], Column], threshold: float, reclassify: float,
) -> tuple[dict[str, DataFrame], list[DataFrame]]:
    """The rows of chunks, deltas and diffs of files that the lake has, and the tables they are read from."""
    spark = taken.sparkSession
    versions = taken.filter("version > 1").select(F.col("file_id").alias("doc_id"), "version")
    again = versions.select(F.col("doc_id").alias("file_id"), (F.col("version") - 1).alias("version"))
    fresh = written(cut(extracted.filter("version > 1").select("file_id", "blocks")).withColumnRenamed("file_id", "doc_id"), "fresh-chunks", compression="zstd")
    before = written(read_lake(spark, base, "chunks").join(again, ["file_id", "version"], "left_semi").withColumnRenamed("file_id", "doc_id"), "chunks-before", compression="zstd")
    counts = written(delta_metadata(chunk_delta(before, fresh, threshold), reclassify), "counts")
    old_bodies = read_lake(spark, base, "documents").join(again, ["file_id", "version"], "left_semi").select(F.col("file_id").alias("doc_id"), "body")
    diffs = diff_log(counts, old_bodies, documents.filter("version > 1").select(F.col("file_id").alias("doc_id"), "body"))
    done = reuse_chunk_work(fresh, before).select("doc_id", "chunk_index", F.col("work").alias("kept")).join(versions, "doc_id")
    worked = fresh.join(done, ["doc_id", "chunk_index"]).withColumn("work", F.coalesce("kept", work(F.col("content")))).withColumn("reused", F.col("kept").isNotNull())
    rows = {"chunks": worked.drop("kept"), "deltas": counts.join(versions, "doc_id"), "diffs": diffs.join(versions, "doc_id")}
    return {name: df.withColumnRenamed("doc_id", "file_id") for name, df in rows.items()}, [fresh, before, counts]


def upload_stream(uploads: DataFrame, base: str, checkpoint: str, **how: Any) -> StreamingQuery:
    """Uploads as they come, through upload_batch; takes all that is there and stops. The checkpoint names the writer."""
    return uploads.writeStream.foreachBatch(lambda batch, number: upload_batch(batch, base, checkpoint, number, **how) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
