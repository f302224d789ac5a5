"""Citations: one for each chunk, links, bodies, references of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def generate_citations(chunks: DataFrame, quote: int = 150) -> DataFrame:
    return chunks.select("doc_id", (F.col("chunk_index") + 1).alias("citation_index"), "chunk_index", "source_locator", F.substring("content", 1, quote).alias("quote"))


def citation_url(file: Column, index: Column) -> Column:
    return F.concat(F.lit("/api/v1/vault/files/"), file.cast("string"), F.lit("/download#chunk="), index.cast("string"))


def assemble_markdown(documents: DataFrame, citations: DataFrame) -> DataFrame:
    """The short body: title, summary and the list of citations in index order."""
    line = F.concat(F.lit("["), F.col("citation_index"), F.lit("] "), F.col("source_locator"))
    listed = citations.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("citation_index", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    body = F.concat(F.lit("# "), F.coalesce("title", F.lit("")), F.lit("\n\n"), F.coalesce("summary", F.lit("")), F.when(F.col("lines").isNotNull(), F.concat(F.lit("\n\n## Citations\n\n"), F.col("lines"))).otherwise(""))
    return documents.join(listed, "doc_id", "left").select("doc_id", body.alias("body_markdown"))


def assemble_full_markdown(documents: DataFrame, citations: DataFrame, quotes: int = 10) -> DataFrame:
    """The long body, for documents with sections (heading, summary, key_points), people (name, role) and key_quotes."""
    section = F.transform("sections", lambda s: F.concat(F.lit("## "), s["heading"], F.lit("\n\n"), s["summary"], F.array_join(F.transform(s["key_points"], lambda p: F.concat(F.lit("\n- "), p)), "")))
    people = F.transform("people", lambda p: F.concat(F.lit("- "), p["name"], F.when(p["role"].isNotNull(), F.concat(F.lit(" ("), p["role"], F.lit(")"))).otherwise("")))
    said = F.transform(F.slice("key_quotes", 1, quotes), lambda q: F.concat(F.lit("> "), q))
    listed = citations.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("citation_index", "source_locator"))), lambda x: F.concat(F.lit("["), x["citation_index"], F.lit("] "), x["source_locator"])).alias("cited"))

    def part(title: str, lines: Column, by: str) -> Column:
        return F.when(F.size(lines) > 0, F.concat(F.lit(f"## {title}\n\n"), F.array_join(lines, by)))

    parts = [F.concat(F.lit("# "), F.col("title")), F.col("summary"), F.when(F.size("sections") > 0, F.array_join(section, "\n\n")), part("People", people, "\n"), part("Key quotes", said, "\n\n"), part("Citations", F.col("cited"), "\n")]
    return documents.join(listed, "doc_id", "left").select("doc_id", F.concat_ws("\n\n", *parts).alias("body_markdown"))


def document_citations(documents: DataFrame, citations: DataFrame) -> DataFrame:
    """All citations of each document with their link, by index."""
    rows = citations.join(documents.select("doc_id", "source_file_id"), "doc_id")
    return rows.select("doc_id", "citation_index", "quote", citation_url(F.col("source_file_id"), F.col("citation_index")).alias("url")).orderBy("doc_id", "citation_index")


def extract_source_refs(answers: DataFrame, sources: DataFrame, quote: int = 200) -> DataFrame:
    """[Source N] in answers (id, answer): each N once, in order of first appearance, where sources (id, n, ...) has it."""
    numbers = F.array_distinct(F.transform(F.regexp_extract_all("answer", F.lit(r"\[Source (\d{1,9})\]"), F.lit(1)), lambda x: x.cast("int")))
    refs = answers.select("id", F.posexplode(numbers).alias("seen", "n")).join(sources, ["id", "n"])
    place = F.row_number().over(Window.partitionBy("id").orderBy("seen"))
    return refs.select("id", "n", place.alias("place"), "doc_id", "chunk_index", F.substring("content", 1, quote).alias("quote"), citation_url(F.col("doc_id"), F.col("chunk_index")).alias("url"))


def verify_citations(citations: DataFrame, chunks: DataFrame) -> DataFrame:
    """Citations without a chunk to stand on."""
    return citations.join(chunks.select("doc_id", "chunk_index"), ["doc_id", "chunk_index"], "left_anti")
