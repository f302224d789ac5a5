"""Secret scans with corpus-wide ownership frequency."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import let
from millrace.llm.common import joined_spans, kind_count, spread_join, written


@dataclass(frozen=True)
class Kind:
    """A kind of secret: its pattern, the group that is the secret itself and its least length, and a cheap test that
    every text with a match passes. Of base kinds all matches are reported, of others those that look owned."""

    name: str
    pattern: str
    group: int
    least: int
    maybe: str
    base: bool = True


#: The kinds in their order. hex takes runs of 24 and more at once: shorter runs are dropped anyway. login
#: and blob take runs of any length whole (possessive, so in linear time). A jwt starts where its run does. A login starts at the first
#: letter of its scheme, which opens its run but for up to 256 digits, dots, pluses or dashes.
KINDS = (
    Kind("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6, "text like '%=%' or text like '%:%'"),
    Kind("access", r"AKIA[A-Z0-9]+", 0, 20, "contains(text, 'AKIA')"),
    Kind("hex", r"[0-9a-f]{24,}", 0, 24, "true"),
    Kind("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", 0, 28, "contains(text, 'eyJ')", False),
    Kind("login", r"(?:(?<![a-z0-9+.-])|(?<=[0-9+.-])(?<=(?<![a-z0-9+.-])[0-9+.-]{1,256}))[a-z][a-z0-9+.-]++://[^\s/:@?#]++:([^\s/:@?#]{6,}+)@", 1, 6, "contains(text, '://') and contains(text, '@')", False),
    Kind("blob", r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[a-z0-9+/_-]*+[A-Z])(?=[A-Z0-9+/_-]*+[a-z])[A-Za-z0-9+/_-]{32,}+", 0, 32, "text rlike '[A-Za-z0-9+/_-]{32}'", False),
)
#: Matches of a text whose places are summed together.
BLOCK = 256
PLACEHOLDER = r"(?i)example|sample|dummy|changeme|placeholder|your[_-]?|xxxx|^(.)\1+$|^0?12345"


def _spans(kind: Kind, order: int) -> Column:
    """The matches of a kind in column text, leftmost and not overlapping: array of (start, rank, end, kind, value).

    split() gives what lies between matches, so running sums of both lengths are the places, in code points. The sums run
    inside blocks of BLOCK matches, then over the blocks: growing one array match by match would copy it each time.
    """
    pattern = F.lit(kind.pattern)
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,value:string>>")
    whole, value = F.regexp_extract_all("text", pattern, F.lit(0)), F.regexp_extract_all("text", pattern, F.lit(kind.group))
    parts = F.arrays_zip(F.split("text", kind.pattern, -1).alias("gap"), whole.alias("whole"), value.alias("value"))

    def span(start: Column, end: Column, value: Column) -> Column:
        return F.struct(start.alias("start"), F.lit(order).alias("rank"), end.alias("end"), F.lit(kind.name).alias("kind"), value.alias("value"))

    def step(seen: Column, part: Column) -> Column:
        start = seen["at"] + F.char_length(part["gap"])
        end = start + F.coalesce(F.char_length(part["whole"]), F.lit(0))
        good = F.char_length(part["value"]) >= kind.least
        return F.struct(end.alias("at"), F.when(good, F.concat(seen["found"], F.array(span(start, end, part["value"])))).otherwise(seen["found"]).alias("found"))

    def block(parts: Column, b: Column) -> Column:
        return F.aggregate(F.slice(parts, b * BLOCK + 1, F.lit(BLOCK)), F.struct(F.lit(0).alias("at"), empty.alias("found")), step)

    def placed(blocks: Column) -> Column:
        ends = F.aggregate(blocks, F.array(F.lit(0)), lambda ends, b: F.concat(ends, F.array(F.element_at(ends, -1) + b["at"])))
        shift = lambda b, at: F.transform(b["found"], lambda s: span(s["start"] + at, s["end"] + at, s["value"]))
        return let(ends, lambda ends: F.flatten(F.transform(blocks, lambda b, i: shift(b, ends[i]))))

    blocked = let(parts, lambda parts: F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / BLOCK).cast("int")), lambda b: block(parts, b)))
    return F.when(F.expr(kind.maybe) & F.col("text").rlike(kind.pattern), let(blocked, placed)).otherwise(empty)


def scan_secrets(docs: DataFrame, id: str = "doc_id", text: str = "text", owner: str = "source", repository: Sequence[str] = ("source", "lang"), most_owners: int = 2, most_repositories: int = 4, kinds: Sequence[Kind] = KINDS) -> DataFrame:
    """Find secrets in every whole text and tell owner-specific ones from widely copied examples.

    The scan finds candidates of all kinds in one pass. Their hashes are then aggregated over the whole corpus by
    distinct repositories and owners (columns of docs; repository is a combination of columns), pre-aggregated by the
    tasks, so a string that a third of all rows hold is a row for each task and repository; where rows look theirs up, such strings are broadcast (spread_join). A candidate that at most
    most_owners owners hold in at most most_repositories repositories together and that is no placeholder looks live; the others, more
    widely copied, are examples. Base kinds report all their
    matches, the further kinds only the live-looking ones.

    Returns id, spans (array of structs start, rank, end, kind, value: by start, then kind as listed), base (those of base
    kinds), live and example (numbers of spans). Places are code points, end exclusive. Null text counts as empty;
    null owners or repositories are one owner, one repository. Rows that repeat id and text are reported alike and
    counted once for their repository. An empty table gives an empty result; other columns are not read.
    """
    mark = F.md5(F.concat_ws("|", F.coalesce(F.col(id).cast("string"), F.lit("null")), F.md5(F.coalesce(F.col(text), F.lit("")))))
    read = docs.select(mark.alias("mark"), F.col(id).alias("id"), F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"), F.to_json(F.struct(*(F.col(c) for c in repository))).alias("repository"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = F.concat(*(_spans(k, i) for i, k in enumerate(kinds)))
    rows = written(read.select("mark", "id", "owner", "repository", found.alias("spans")), "secret-candidates")

    each = rows.filter(F.size("spans") > 0).select("mark", "owner", "repository", F.explode("spans").alias("span")).withColumn("hash", F.sha2("span.value", 256))
    by_owner = each.groupBy("hash", "owner", "repository").agg(F.first("span.value").alias("value"), F.count(F.lit(1)).alias("rows"))
    by_owner = by_owner.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n"), F.first("value").alias("value"), F.sum("rows").alias("rows"))
    held = by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("n").alias("repositories"), F.first("value").alias("value"), F.sum("rows").alias("rows"))
    varied = F.size(F.array_distinct(F.split("value", ""))) >= 5
    live = (F.col("owners") <= most_owners) & (F.col("repositories") <= most_repositories) & ~F.col("value").rlike(PLACEHOLDER) & varied
    judged = spread_join(each.select("mark", "span", "hash").distinct(), written(held.select("hash", live.alias("live"), "rows"), "secret-owners"), ["hash"], "rows")

    further = [k.name for k in kinds if not k.base]
    extra = F.sort_array(F.collect_list(F.when(F.col("live") & F.col("span.kind").isin(further), F.col("span"))))
    by_doc = judged.groupBy("mark").agg(extra.alias("extra"), F.count_if("live").alias("live"), F.count_if(~F.col("live")).alias("example"))
    base = F.filter("spans", lambda s: ~s["kind"].isin(further))
    out = rows.select("mark", "id", base.alias("base")).join(by_doc, "mark", "left")
    spans = F.sort_array(F.concat("base", F.coalesce("extra", F.array().cast(rows.schema["spans"].dataType))))
    zero = F.lit(0).cast("long")
    return out.select(F.col("id").alias(id), spans.alias("spans"), F.sort_array("base").alias("base"), F.coalesce("live", zero).alias("live"), F.coalesce("example", zero).alias("example"))


def digest(found: DataFrame, id: str = "doc_id", kinds: Sequence[Kind] = KINDS) -> DataFrame:
    """Counts of the base kinds, a hash of the base spans and all spans as text."""
    counts = [kind_count("base", k.name).alias(f"n_{k.name}") for k in kinds if k.base]
    return found.select(id, *counts, F.sha2(joined_spans(F.col("base")), 256).alias("base_sha256"), joined_spans(F.col("spans")).alias("spans"), F.col("live").alias("n_live"), F.col("example").alias("n_example"))
