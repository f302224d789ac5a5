"""Substrings by their grams: which texts hold which needles, without comparing every text with every needle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.sources.shared import written

#: Characters of a gram; how many of its rarest grams a needle is looked up by.
GRAM, RAREST = 3, 4


def grams(text: Column, n: int = GRAM) -> Column:
    """The different runs of n characters of a text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def gram_postings(texts: DataFrame, wanted: DataFrame, n: int = GRAM, id: str = "doc_id", text: str = "hay") -> DataFrame:
    """gram, id for the grams that are wanted (gram): a text is cut where it lies, and only what is wanted goes on."""
    return texts.select(F.col(id).alias("doc_id"), F.explode(grams(F.col(text), n)).alias("gram")).join(wanted.select("gram").distinct(), "gram", "left_semi").withColumnRenamed("doc_id", id)


def containing(needles: DataFrame, hays: DataFrame) -> DataFrame:
    """query_id, doc_id, created_at of all pairs whose text (hays: doc_id, created_at, hay) holds the needle (query_id, needle).

    Equal needles are looked up once. A needle of three characters or more is looked up by its RAREST grams: a text that holds it has them all. Only
    these texts are read and searched. A shorter needle is the beginning of a gram, or all there is of one at a text's end, so it is
    looked up among the texts' runs of its own length, and nothing is left to search. Each step is an equi-join on a gram or an id. Null
    and empty needles and null texts hold nothing.
    """
    asked = needles.filter(F.col("needle") != "").select("query_id", "needle", F.xxhash64("needle").alias("code"))
    once = written(asked.select("code", "needle").distinct().withColumn("n", F.least(F.char_length("needle"), F.lit(GRAM))), "needles")
    out = None
    for n in sorted(r["n"] for r in once.select("n").distinct().collect()):
        some = once.filter(F.col("n") == n)
        if n < GRAM:
            short = some.withColumnRenamed("needle", "gram")
            found = gram_postings(hays, short, n).join(short, "gram").select("code", F.col("gram").alias("needle"), "doc_id")
        else:
            found = _by_rarest(some, hays)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return hays.select(F.lit(None).cast(needles.schema["query_id"].dataType).alias("query_id"), "doc_id", "created_at").limit(0)
    return asked.join(out.join(hays.select("doc_id", "created_at"), "doc_id"), ["code", "needle"]).select("query_id", "doc_id", "created_at")


def _by_rarest(needles: DataFrame, hays: DataFrame) -> DataFrame:
    """code, needle, doc_id by the rarest grams of each needle, then by the texts themselves."""
    of_needle = written(needles.select("code", F.explode(grams(F.col("needle"))).alias("gram")), "needle-grams")
    postings = written(gram_postings(hays, of_needle), "gram-postings")
    held = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("texts"))
    rare = F.row_number().over(Window.partitionBy("code").orderBy("texts", "gram"))  # a window over one needle's grams
    chosen = of_needle.join(held, "gram", "left").withColumn("texts", F.coalesce("texts", F.lit(0))).withColumn("place", rare).filter(F.col("place") <= RAREST)
    chosen = written(chosen.select("code", "gram", F.count(F.lit(1)).over(Window.partitionBy("code")).alias("need")), "rarest-grams")
    likely = postings.join(chosen, "gram").groupBy("code", "need", "doc_id").agg(F.count(F.lit(1)).alias("have")).filter("have = need")
    pairs = likely.select("code", "doc_id").join(needles.select("code", "needle"), "code")
    return pairs.join(hays.select("doc_id", "hay"), "doc_id").filter(F.contains("hay", "needle")).select("code", "needle", "doc_id")
