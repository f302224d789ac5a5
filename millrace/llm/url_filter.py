"""URL filters: host and path rules, and trust that spreads over the host graph."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import UPPER, discard, spread_join, written

#: A tag of HTML that can refer to a host, whole, and the first such reference in it, with its scheme or without; group 1 is the host.
TAG = r"(?i)<(?:a|area|link|base|iframe|frame|form)\s[^>]*+"
LINK = r"""(?is)(?:href|src|action)\s*+=\s*+["']?+\s*+(?:[a-z][a-z0-9+.-]*+:)?+//([^/?#"'\s>]++)"""
#: Rounds whose results are written together; edges from which on a host is not dealt to one task.
TOGETHER, HUB = 4, 10_000


def _lower(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def url_host(url: Column) -> Column:
    """What stands between the first :// and the next /, ? or #, A-Z lower-cased; null or no ://: empty."""
    return F.coalesce(_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host, up to ? or #; null or no ://: empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest of the rules (verdict, host, path) that fits: struct<rule, verdict>, or null. The list is in the plan: keep it short."""
    def fits(of: str, start: str) -> Column:
        return ((host == of) | host.endswith("." + of)) & path.startswith(start)

    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    cases = [(fits(h, p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in ordered]
    return reduce(lambda c, x: c.when(*x), cases[1:], F.when(*cases[0])) if cases else F.lit(None).cast("struct<rule:string,verdict:string>")


def host_edges(pages: DataFrame) -> DataFrame:
    """Edges of the host graph with weights: source, target, weight; from columns host and html.

    References to other hosts (links, areas, frames, forms, bases) count once a page. Each host and its parent domain also point at each other (weight 1),
    up to the registered name: subdomains of one owner share their standing.
    """
    tags = F.regexp_extract_all("html", F.lit(TAG), F.lit(0))
    links = pages.select("host", F.explode(F.array_distinct(F.transform(tags, lambda tag: _lower(F.regexp_extract(tag, LINK, 1))))).alias("target"))
    linked = links.filter((F.col("host") != "") & (F.col("target") != "") & (F.col("host") != F.col("target"))).groupBy(F.col("host").alias("source"), "target").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    hosts = pages.select("host").filter("host <> ''").distinct().filter(~F.col("host").rlike(r"^[0-9.]+(:[0-9]+)?$"))
    labels = F.split("host", r"\.")
    up = hosts.select("host", F.explode(F.when(F.size(labels) > 2, F.sequence(F.lit(2), F.size(labels) - 1))).alias("n"), labels.alias("labels"))
    names = up.select(
        F.array_join(F.slice("labels", -F.col("n") - 1, F.col("n") + 1), ".").alias("child"),
        F.array_join(F.slice("labels", -F.col("n"), F.col("n")), ".").alias("parent"),
    ).distinct()
    both = names.select(F.col("child").alias("source"), F.col("parent").alias("target")).unionByName(names.select(F.col("parent").alias("source"), F.col("child").alias("target")))
    return linked.unionByName(both.withColumn("weight", F.lit(1.0))).groupBy("source", "target").agg(F.sum("weight").alias("weight"))


def rounds_for(damping: float, tolerance: float) -> int:
    """Rounds after which no rank can change by more than tolerance: what is still on its way is damping ** rounds in all."""
    return max(1, math.ceil(math.log(tolerance) / math.log(damping)))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 1e-3) -> DataFrame:
    """Personalised PageRank from seeds: walk, host, rank, for any number of walks at once, each with its own edges (walk, source,
    target, weight) and seeds (walk, host, seed; summing to 1).

    Each round is a join on the edges' source and an aggregation by target, pre-aggregated by the tasks. Hubs, hosts with over
    1 / (4 x shuffle partitions) of all edges and HUB at least (so fewer than four times the partitions), have their edges apart: their ranks are broadcast to
    these, which are never shuffled. There are as many rounds (rounds_for) as it takes until the ranks are within tolerance of their limits,
    whatever the graph.
    """
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = edges.groupBy("walk", "source").agg(F.sum("weight").alias("total"), F.count(F.lit(1)).alias("n"))
    out = written(out.withColumnRenamed("source", "host"), "sources")
    most = max(HUB, (out.agg(F.sum("n")).first()[0] or 0) // (4 * parts))
    hubs = out.filter(F.col("n") > most).select("walk", "host")
    steps = spread_join(edges.withColumnRenamed("source", "host"), out, ["walk", "host"], "n")
    steps = written(steps.select("walk", "host", "target", (F.col("weight") / F.col("total") * damping).alias("step")), "steps")
    wide = None if hubs.isEmpty() else written(steps.join(F.broadcast(hubs), ["walk", "host"]), "hub-steps")
    steps = steps if wide is None else written(steps.join(F.broadcast(hubs), ["walk", "host"], "left_anti"), "steps")
    seeds = written(seeds.select("walk", "host", (F.col("seed") * (1 - damping)).alias("rank")), "seeds")
    rank, kept = seeds, seeds
    for k in range(1, (rounds := rounds_for(damping, tolerance)) + 1):
        sent = steps.join(rank, ["walk", "host"])
        if wide is not None:
            sent = sent.unionByName(wide.join(F.broadcast(rank.join(F.broadcast(hubs), ["walk", "host"])), ["walk", "host"]))
        sent = sent.select("walk", F.col("target").alias("host"), (F.col("rank") * F.col("step")).alias("rank"))
        rank = sent.unionByName(seeds).groupBy("walk", "host").agg(F.sum("rank").alias("rank"))
        if k % TOGETHER == 0 or k == rounds:
            rank = written(rank, "rank")
            if kept is not seeds:
                discard(kept)
            kept = rank
    return rank


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], threshold: float = 0.0, damping: float = 0.85, tolerance: float = 1e-3, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Judge every page's URL: by the longest rule that fits, else by what its host's neighbours are worth.

    A rule (verdict, host, path) fits its host and the subdomains, for paths that start with its path. Trusted seeds are
    hosts with pages that a rule allows and none that one blocks, in proportion to their pages; blocked seeds are hosts
    with blocked pages. Trust spreads along links, distrust against them (who links to a bad host is suspect). A
    host's standing is (trust - distrust) / (trust + distrust), 0 for hosts that neither reaches; without a rule
    a page is blocked if its host's standing is under the threshold.

    Ranks are computed on hosts, pre-aggregated from pages, so a host with a third of all pages is one row; in the join back to
    pages such hosts are broadcast (spread_join). Returns id, host, path, rule, verdict, standing. Null
    URLs, and those without ://, have empty host and path: no rule, standing 0. Null or empty html has no links; very long URLs and html are
    read whole, in linear time; of each tag the first reference counts; repeated rows are judged alike and each counts; an empty table gives an empty result; other columns are not read.
    """
    host, path = url_host(F.col(url)), url_path(F.col(url))
    read = pages.select(F.col(id).alias("id"), host.alias("host"), path.alias("path"), F.col(html).alias("html"))
    ruled = read.withColumn("by", matching_rule(F.col("host"), F.col("path"), rules))
    judged = ruled.select("id", "host", "path", "by")

    counts = ruled.filter("host <> ''").groupBy("host").agg(F.count_if(F.col("by.verdict") == "allow").alias("good"), F.count_if(F.col("by.verdict") == "block").alias("bad"), F.count(F.lit(1)).alias("n"))
    counts = written(counts, "hosts")
    edges = written(host_edges(read.select("host", "html")), "host-edges")

    def seeds(column: Column) -> DataFrame:
        chosen = counts.withColumn("pages", column).filter("pages > 0")
        total = chosen.agg(F.sum("pages")).first()[0]
        return chosen.select("host", (F.col("pages") / F.lit(total)).cast("double").alias("seed"))

    back = edges.select(F.lit("doubt").alias("walk"), F.col("target").alias("source"), F.col("source").alias("target"), "weight")
    start = seeds(F.when(F.col("bad") == 0, F.col("good"))).withColumn("walk", F.lit("trust")).unionByName(seeds(F.col("bad")).withColumn("walk", F.lit("doubt")))
    ranks = propagate(edges.withColumn("walk", F.lit("trust")).unionByName(back), start, damping, tolerance)
    of = lambda walk: F.coalesce(F.sum(F.when(F.col("walk") == walk, F.col("rank"))), F.lit(0.0)).alias(walk)
    both = counts.select("host", "n").join(ranks, "host", "left").groupBy("host", "n").agg(of("trust"), of("doubt"))
    standing = F.when(F.col("trust") + F.col("doubt") > 0, (F.col("trust") - F.col("doubt")) / (F.col("trust") + F.col("doubt"))).otherwise(0.0)
    known = spread_join(judged.filter("host <> ''"), written(both.select("host", "n", standing.alias("standing")), "standings"), ["host"], "n")
    out = known.unionByName(judged.filter("host = ''").withColumn("standing", F.lit(0.0)))
    shown = F.round(F.coalesce("standing", F.lit(0.0)), 6)
    return out.select(
        F.col("id").alias(id), "host", "path", F.col("by.rule").alias("rule"),
        F.coalesce("by.verdict", F.when(shown < threshold, "block").otherwise("allow")).alias("verdict"), shown.alias("standing"),
    )
