"""Raw files and lake tables: in and out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.large import STEP, file_hashes, readable

#: The adapters in the order in which they are asked, with their extensions and MIME types.
CODE_LANGUAGES = {
    ".py": "python", ".js": "javascript", ".ts": "typescript", ".tsx": "typescript", ".jsx": "javascript", ".go": "go", ".rs": "rust", ".c": "c", ".h": "c", ".cpp": "cpp", ".hpp": "cpp", ".cc": "cpp", ".cxx": "cpp",
    ".java": "java", ".rb": "ruby", ".sh": "shell", ".bash": "shell", ".zsh": "shell", ".sql": "sql", ".r": "r", ".swift": "swift", ".kt": "kotlin", ".scala": "scala", ".php": "php", ".pl": "perl", ".lua": "lua",
    ".zig": "zig", ".nim": "nim", ".ex": "elixir", ".exs": "elixir", ".erl": "erlang", ".hs": "haskell", ".cs": "csharp", ".fs": "fsharp", ".clj": "clojure",
}
ADAPTERS = (
    ("code", tuple(CODE_LANGUAGES), ("text/x-python", "text/javascript", "text/typescript", "text/x-go", "text/x-rust", "text/x-c", "text/x-c++", "text/x-java", "text/x-ruby", "text/x-shellscript", "application/javascript", "application/typescript")),
    ("csv", (".csv", ".tsv"), ("text/csv", "text/tab-separated-values", "application/csv")),
    ("docx", (".docx",), ("application/vnd.openxmlformats-officedocument.wordprocessingml.document",)),
    ("html", (".html", ".htm"), ("text/html", "application/xhtml+xml")),
    ("image", (".png", ".jpg", ".jpeg", ".gif", ".bmp", ".webp", ".tiff", ".tif"), ("image/png", "image/jpeg", "image/gif", "image/bmp", "image/webp", "image/tiff")),
    ("json", (".json", ".yaml", ".yml", ".xml"), ("application/json", "application/yaml", "application/x-yaml", "text/yaml", "text/xml", "application/xml")),
    ("markdown", (".md", ".markdown", ".mkd"), ("text/markdown", "text/x-markdown")),
    ("pdf", (".pdf",), ("application/pdf",)),
    ("pptx", (".pptx",), ("application/vnd.openxmlformats-officedocument.presentationml.presentation",)),
    ("text", (".txt",), ("text/plain",)),
    ("xlsx", (".xlsx", ".xls"), ("application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "application/vnd.ms-excel")),
)


def read_raw_files(spark: SparkSession, path: str, glob: str = "*", inline: int = 1 << 30, content: bool = True) -> DataFrame:
    """Files below path with their bytes: path, filename, content, size_bytes, sha256, modified_at. Any store that Spark reads.

    Files of more than inline bytes have null content (a value holds 2 GB at most), but their size and hash, read in pieces; file_parts has their bytes. Whether there are
    any is seen from Spark's listing, which opens no file. With content=False that column is left out, and a task reads STEP bytes of a file at most (file_hashes), unless only
    Spark knows the store.
    """
    most = inline if content or not readable(path) else min(inline, STEP)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    name = F.substring_index("path", "/", -1).alias("filename")
    rows = raw.filter(F.col("length") <= most).select("path", name, "content", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), F.col("modificationTime").alias("modified_at"))
    if raw.select("length").filter(F.col("length") > most).isEmpty():
        return rows if content else rows.drop("content")
    large = file_hashes(spark, path, glob, most).select("path", "filename", F.lit(None).cast("binary").alias("content"), "size_bytes", "sha256", "modified_at")
    both = rows.unionByName(large)
    return both if content else both.drop("content")


def extension(filename: Column) -> Column:
    return F.lower(F.regexp_extract(filename, r"\.[^./]+$", 0))


def route_adapter(filename: Column, content_type: Column) -> Column:
    """The first adapter whose extensions or MIME types fit; null without one."""
    cases = [(extension(filename).isin(*ext) | content_type.isin(*mime), F.lit(name)) for name, ext, mime in ADAPTERS]
    return reduce(lambda c, x: c.when(*x), cases[1:], F.when(*cases[0]))


def write_table(rows: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "append") -> None:
    """A lake table as Parquet. Rows are rebalanced to even files first; partition columns should be few-valued."""
    out = rows.hint("rebalance", *(partition_by or [])).write.mode(mode)
    (out.partitionBy(*partition_by) if partition_by else out).parquet(path)


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path)


def read_jdbc(spark: SparkSession, url: str, dbtable: str, column: str | None = None, lower: str = "0", upper: str = "1", parts: int = 8, **options: str) -> DataFrame:
    """A table of an existing database, read in ranges of a column where one is named."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=dbtable, **options)
    if column:
        reader = reader.options(partitionColumn=column, lowerBound=lower, upperBound=upper, numPartitions=parts)
    return reader.load()
