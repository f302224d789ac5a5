"""The entity graph: vertices, mentions and edges, their maintenance, search and traversal."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import canonical_name
from millrace.sources.shared import written

#: The order in which the first mention or relation counts.
FIRST = ("created_at", "doc_id", "position")
#: Names of a document that meet in one task; shares of a key's values that are sorted apart; shares of the other side where two sides of a key meet.
PAIR_BLOCK, SHARES, OTHERS = 256, 64, 16


def relation_type(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, "[^A-Za-z0-9_]", "_"))


def canonical_mentions(mentions: DataFrame) -> DataFrame:
    """Mentions with their key; nameless ones are left out, the type defaults to UNKNOWN. The key is made in the row: names meet by no join, in which a popular
    one would be a task's."""
    keyed = mentions.withColumn("type", F.coalesce("type", F.lit("UNKNOWN"))).withColumn("canonical", canonical_name(F.col("name")))
    return keyed.filter("canonical <> ''")


def _mentions_by_document(mentions: DataFrame) -> DataFrame:
    first = F.struct(*FIRST)
    return canonical_mentions(mentions).groupBy("canonical", "doc_id").agg(F.min(F.struct(first.alias("at"), "name", "type")).alias("f"), F.count(F.lit(1)).alias("n"), F.min("created_at").alias("seen"))


def build_vertices(mentions: DataFrame) -> DataFrame:
    """One vertex for each canonical name: name and type of the first mention, mentions, documents. Tasks pre-aggregate, so a
    popular entity is a row from each."""
    return _vertices(_mentions_by_document(mentions))


def _vertices(by_document: DataFrame) -> DataFrame:
    return by_document.groupBy("canonical").agg(F.min("f").alias("f"), F.min("seen").alias("first_seen"), F.sum("n").alias("mention_count"), F.count(F.lit(1)).alias("document_count")).select(
        "canonical", "f.name", F.col("f.type").alias("entity_type"), "first_seen", "mention_count", "document_count")


def entity_names(mentions: DataFrame) -> DataFrame:
    """The keys of build_vertices alone (canonical), for walks: names are made distinct as they are spelt, so no mention is shuffled. They are written, or Spark
    would make them distinct only once, after the patterns have run for every mention."""
    return written(mentions.select("name").distinct(), "spelt").select(canonical_name(F.col("name")).alias("canonical")).filter("canonical <> ''").distinct()


def build_mentions(mentions: DataFrame) -> DataFrame:
    """Distinct (entity, document) edges."""
    return canonical_mentions(mentions).select("canonical", "doc_id").distinct()


def build_edges(relations: DataFrame, vertices: DataFrame) -> DataFrame:
    """Directed edges between known vertices: weight = occurrences; description, confidence and document of the first.

    Relations are aggregated by their spelling first, then by their keys, and only then are the ends looked up: the patterns run
    for distinct spellings and the semi-joins see edges, not occurrences.
    """
    raw = relations.select("source", "target", "type", F.struct(F.struct(*FIRST).alias("at"), "description", F.coalesce("confidence", F.lit(0.5)).alias("confidence"), F.col("doc_id").alias("source_document_id")).alias("f"))
    spelt = raw.groupBy("source", "target", "type").agg(F.count(F.lit(1)).alias("n"), F.min("f").alias("f"))
    rows = spelt.select(canonical_name(F.col("source")).alias("src"), canonical_name(F.col("target")).alias("dst"), relation_type(F.col("type")).alias("rel"), "n", "f")
    sums = rows.groupBy("src", "dst", "rel").agg(F.sum("n").alias("weight"), F.min("f").alias("f"))
    known = sums.join(vertices.select(F.col("canonical").alias("src")), "src", "left_semi").join(vertices.select(F.col("canonical").alias("dst")), "dst", "left_semi")
    return known.select("src", "dst", "rel", "weight", "f.description", "f.confidence", "f.source_document_id")


def edge_weights(relations: DataFrame, vertices: DataFrame) -> DataFrame:
    """build_edges without what is known of the first relation, for walks: src, dst, rel, weight. The spellings are written, or Spark would ask for every
    relation whether it has ends, by running the patterns, before it counts."""
    spelt = written(relations.groupBy("source", "target", "type").agg(F.count(F.lit(1)).alias("n")), "spelt")
    rows = spelt.select(canonical_name(F.col("source")).alias("src"), canonical_name(F.col("target")).alias("dst"), relation_type(F.col("type")).alias("rel"), "n")
    sums = rows.groupBy("src", "dst", "rel").agg(F.sum("n").alias("weight"))
    return sums.join(vertices.select(F.col("canonical").alias("src")), "src", "left_semi").join(vertices.select(F.col("canonical").alias("dst")), "dst", "left_semi")


def rebuild_graph(mentions: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vertices, mention edges and relation edges of all documents. Mentions are merged by document once, and written, for the first two; vertices once, as
    edges look both of their ends up there."""
    found = written(_mentions_by_document(mentions), "mention-docs")
    vertices = written(_vertices(found), "vertices")
    return vertices, found.select("canonical", "doc_id"), build_edges(relations, vertices)


def merge_graph(vertices: DataFrame, edges: DataFrame, mentions: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges after new documents: counts and weights are added, first names and descriptions stay; relations with unknown ends
    are dropped. The new documents must be new: document counts are added."""
    new = build_vertices(mentions)
    o, n = vertices.alias("o"), new.alias("n")
    both = o.join(n, F.col("o.canonical") == F.col("n.canonical"), "full_outer")
    add = lambda c: (F.coalesce(f"o.{c}", F.lit(0)) + F.coalesce(f"n.{c}", F.lit(0))).alias(c)
    old = F.col("o.canonical").isNotNull()
    pick = lambda c: F.when(old, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c)
    merged = both.select(F.coalesce("o.canonical", "n.canonical").alias("canonical"), pick("name"), pick("entity_type"), pick("first_seen"), add("mention_count"), add("document_count"))
    found = build_edges(relations, merged)
    key = ["src", "dst", "rel"]
    e, f = edges.alias("e"), found.alias("f")
    met = e.join(f, [F.col(f"e.{k}") == F.col(f"f.{k}") for k in key], "full_outer")
    there = F.col("e.src").isNotNull()
    kept = lambda c: F.when(there, F.col(f"e.{c}")).otherwise(F.col(f"f.{c}")).alias(c)
    weight = (F.coalesce("e.weight", F.lit(0)) + F.coalesce("f.weight", F.lit(0))).alias("weight")
    return merged, met.select(*(F.coalesce(f"e.{k}", f"f.{k}").alias(k) for k in key), weight, kept("description"), kept("confidence"), kept("source_document_id"))


class GraphState(NamedTuple):
    """A graph that documents can leave again. What each document gives to an entity or an edge is kept (the multiset whose least
    member names it), beside the sums over all documents. Edges are kept with unknown ends too: an end may become known."""

    mention_docs: DataFrame  # canonical, doc_id, f (at, name, type), n, seen
    relation_docs: DataFrame  # src, dst, rel, doc_id, f (at, description, confidence), n
    vertices: DataFrame  # canonical, f, seen, n, documents
    edges: DataFrame  # src, dst, rel, f, n


_VERTEX, _EDGE = ["canonical"], ["src", "dst", "rel"]


def _relations_by_document(relations: DataFrame) -> DataFrame:
    first = F.struct(F.struct(*FIRST).alias("at"), "description", F.coalesce("confidence", F.lit(0.5)).alias("confidence"))
    spelt = relations.select("source", "target", "type", "doc_id", first.alias("f")).groupBy("source", "target", "type", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("f").alias("f"))
    rows = spelt.select(canonical_name(F.col("source")).alias("src"), canonical_name(F.col("target")).alias("dst"), relation_type(F.col("type")).alias("rel"), "doc_id", "n", "f")
    return rows.groupBy(*_EDGE, "doc_id").agg(F.sum("n").alias("n"), F.min("f").alias("f"))


def _whole(docs: DataFrame, key: list[str]) -> DataFrame:
    """Sums over documents, and the least of what they give first."""
    seen = [F.min("seen").alias("seen")] if "seen" in docs.columns else []
    return docs.groupBy(*key).agg(F.min("f").alias("f"), *seen, F.sum("n").alias("n"), F.count(F.lit(1)).alias("documents"))


def graph_state(mentions: DataFrame, relations: DataFrame) -> GraphState:
    """The state after a set of documents; its tables are written."""
    found, related = written(_mentions_by_document(mentions), "mention-docs"), written(_relations_by_document(relations), "relation-docs")
    return GraphState(found, related, written(_whole(found, _VERTEX), "vertex-state"), written(_whole(related, _EDGE), "edge-state"))


def _changed(whole: DataFrame, docs: DataFrame, gone: DataFrame, new: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Per-document rows and sums after documents went and came.

    Sums change by signed deltas: what came counts plus, what went minus, both merged by key before they meet the sums. The first stays, or a
    new one takes its place; only where the first's own document went, the next is looked up among the key's documents. Keys
    without documents go.
    """
    left = docs.join(gone, "doc_id", "left_semi")
    kept = written(docs.join(gone, "doc_id", "left_anti").unionByName(new), "kept-docs")
    timed = "seen" in docs.columns
    sign = lambda df, s: df.select(*key, (F.col("n") * s).alias("n"), F.lit(s).cast("long").alias("documents"), *([F.when(F.lit(s > 0), F.col("seen")).alias("seen")] if timed else []), F.when(F.lit(s > 0), F.col("f")).alias("f"), F.when(F.lit(s < 0), F.struct("f", *(["seen"] if timed else []))).alias("went"))
    least = [F.min("seen").alias("seen")] if timed else []
    delta = sign(new, 1).unionByName(sign(left, -1)).groupBy(*key).agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"), F.min("f").alias("f"), F.min("went.f").alias("lost"), *least, *([F.min("went.seen").alias("lost_seen")] if timed else []))
    o, d = whole.alias("o"), delta.alias("d")
    met = o.join(d, [F.col(f"o.{k}") == F.col(f"d.{k}") for k in key], "full_outer")
    add = lambda c: (F.coalesce(f"o.{c}", F.lit(0)) + F.coalesce(f"d.{c}", F.lit(0))).alias(c)
    lost = F.col("d.lost") <= F.col("o.f")
    if timed:
        lost |= F.col("d.lost_seen") <= F.col("o.seen")
    times = [F.least("o.seen", "d.seen").alias("seen")] if timed else []
    first = F.when(F.col("o.f").isNull() | (F.col("d.f") < F.col("o.f")), F.col("d.f")).otherwise(F.col("o.f"))
    sums = written(met.select(*(F.coalesce(f"o.{k}", f"d.{k}").alias(k) for k in key), first.alias("f"), *times, add("n"), add("documents"), F.coalesce(lost, F.lit(False)).alias("open")).filter("documents > 0"), "sums")
    again = _whole(kept.join(sums.filter("open").select(*key), key, "left_semi"), key).select(*whole.columns)
    return kept, written(sums.filter("NOT open").select(*whole.columns).unionByName(again), "state")


def change_graph(state: GraphState, gone: DataFrame, mentions: DataFrame, relations: DataFrame) -> GraphState:
    """The state after documents went (gone: doc_id) and others came, with their mentions and relations. An edited document goes and comes in
    one change. The result equals the state of what is left, built anew. Canonical names and edges are not null."""
    ids = gone.select("doc_id").distinct()
    found = _changed(state.vertices, state.mention_docs, ids, written(_mentions_by_document(mentions), "new-mentions"), _VERTEX)
    related = _changed(state.edges, state.relation_docs, ids, written(_relations_by_document(relations), "new-relations"), _EDGE)
    return GraphState(found[0], related[0], found[1], related[1])


def visible_graph(state: GraphState) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vertices, mention edges and the relation edges whose ends are known, as rebuild_graph has them."""
    v = state.vertices.select("canonical", "f.name", F.col("f.type").alias("entity_type"), F.col("seen").alias("first_seen"), F.col("n").alias("mention_count"), F.col("documents").alias("document_count"))
    known = state.edges.join(v.select(F.col("canonical").alias("src")), "src", "left_semi").join(v.select(F.col("canonical").alias("dst")), "dst", "left_semi")
    edges = known.select("src", "dst", "rel", F.col("n").alias("weight"), "f.description", "f.confidence", F.col("f.at.doc_id").alias("source_document_id"))
    return v, state.mention_docs.select("canonical", "doc_id"), edges


def search_entities(vertices: DataFrame, text: str, type: str | None = None, most: int = 20) -> DataFrame:
    rows = vertices.filter(F.contains("canonical", F.lit(text.lower())))
    if type is not None:
        rows = rows.filter(F.col("entity_type") == type)
    return rows.orderBy(F.desc("document_count"), "canonical").limit(most)


def entity_detail(vertices: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """For each wanted vertex (canonical) its edges in both directions; a row without an edge if it has none."""
    wanted = vertices.join(ids.select("canonical"), "canonical", "left_semi").select("canonical", "name", "entity_type")
    out = edges.select(F.col("src").alias("canonical"), F.lit("out").alias("direction"), F.col("dst").alias("other"), "rel", "weight")
    back = edges.select(F.col("dst").alias("canonical"), F.lit("in").alias("direction"), F.col("src").alias("other"), "rel", "weight")
    return wanted.join(out.unionByName(back), "canonical", "left")


def _undirected(edges: DataFrame, mentions: DataFrame | None, type: str | None = None) -> DataFrame:
    """Pairs (a, b) in both directions with their heaviest weight; with mentions, documents are vertices too (doc:id)."""
    rows = edges if type is None else edges.filter(F.col("rel") == type)
    pairs = rows.filter("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b"), "weight")
    if mentions is not None and type is None:
        pairs = pairs.unionByName(mentions.select(F.col("canonical").alias("a"), F.concat(F.lit("doc:"), "doc_id").alias("b"), F.lit(1).cast("long").alias("weight")))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    return both.groupBy("a", "b").agg(F.max("weight").alias("weight"))


def _twins(pairs: DataFrame, ends: DataFrame) -> DataFrame:
    """end and class of the vertices among ends (end) that have neighbours: vertices with the same neighbours are one class, which the first of them names.

    Sets are told apart by their size and 128 bits of hashes, which tasks pre-aggregate; each member's neighbours are then looked up among its class's, and
    a vertex with others is a class of its own.
    """
    near = written(ends.select("end").distinct().join(pairs, F.col("end") == F.col("a")).select("end", F.col("b").alias("node")), "near")
    marks = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"h{i}") for i in range(2)]
    sets = written(near.groupBy("end").agg(F.count(F.lit(1)).alias("n"), *marks), "sets")
    first = sets.groupBy("n", "h0", "h1").agg(F.min("end").alias("class"))
    named = written(sets.join(first, ["n", "h0", "h1"]).select("end", "class"), "classes")
    checked = near.join(named.filter("end <> class"), "end").join(near.select(F.col("end").alias("class"), "node"), ["class", "node"], "left_anti").select("end").distinct()
    return named.join(checked.withColumn("odd", F.lit(True)), "end", "left").select("end", F.when(F.col("odd"), F.col("end")).otherwise(F.col("class")).alias("class"))


def _crossed(left: DataFrame, right: DataFrame, key: list[str], a: str, b: str) -> DataFrame:
    """Each row of left with each row of right that has the same key, by shares of both (by their columns a and b): a large key is dealt over tasks, and
    what stands side by side repeats soon, so files of the result are packed well."""
    parts, all_of = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    share = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    one = left.select("*", share(a, SHARES).alias("_a"), all_of(OTHERS).alias("_b")).repartition(parts, *key, "_a", "_b")
    two = right.select("*", share(b, OTHERS).alias("_b"), all_of(SHARES).alias("_a")).repartition(parts, *key, "_a", "_b")
    return one.join(two, [*key, "_a", "_b"]).drop("_a", "_b")


def neighbors(edges: DataFrame, seeds: DataFrame, depth: int = 2, type: str | None = None, mentions: DataFrame | None = None) -> DataFrame:
    """Vertices within depth hops (at most 5) of each seed: seed, node, hop; the seed itself is left out.

    What lies beyond a seed's neighbours depends on these alone, so seeds with the same neighbours (_twins) walk once, from their set of neighbours. Breadth first
    for all sets at once: the frontier is distinct, visited pairs are anti-joined, each hop is written to the shared folder, and an empty frontier
    ends the walk. In the end each set's vertices are given to its seeds (_crossed): the rows asked for are as many as that, and the last step only writes them.
    """
    pairs = written(_undirected(edges, mentions, type).select("a", "b"), "pairs")
    members = written(_twins(pairs, seeds.select(F.col("seed").alias("end"))), "members")
    seen = written(members.select("class").distinct().join(pairs, F.col("class") == F.col("a")).select("class", F.col("b").alias("node"), F.lit(1).alias("hop")), "seen") if depth > 0 else None
    if seen is None:
        return members.select(F.col("end").alias("seed"), F.col("end").alias("node"), F.lit(0).alias("hop")).limit(0)
    frontier = seen.select("class", "node")
    for hop in range(2, min(depth, 5) + 1):
        reached = frontier.join(pairs, F.col("node") == F.col("a")).select("class", F.col("b").alias("node")).distinct()
        new = written(reached.join(seen.select("class", "node"), ["class", "node"], "left_anti").withColumn("hop", F.lit(hop)), "hop")
        if new.isEmpty():
            break
        seen, frontier = seen.unionByName(new), new.select("class", "node")
    if mentions is not None:
        seen = seen.filter(~F.startswith("node", F.lit("doc:")))
    return _crossed(seen, members.select("class", F.col("end").alias("seed")), ["class"], "node", "seed").filter("node <> seed").select("seed", "node", "hop")


def neighborhood_edges(edges: DataFrame, found: DataFrame, min_weight: int = 1) -> DataFrame:
    """The edges among each seed and what neighbors found for it, of the given weight or more."""
    nodes = found.select("seed", "node").unionByName(found.select("seed", F.col("seed").alias("node"))).distinct()
    a, b = nodes.withColumnRenamed("node", "src"), nodes.withColumnRenamed("node", "dst")
    return edges.filter(F.col("weight") >= min_weight).join(a, "src").join(b, ["seed", "dst"]).select("seed", "src", "dst", "rel", "weight")


def shortest_path(edges: DataFrame, wanted: DataFrame, max_hops: int = 4, mentions: DataFrame | None = None) -> DataFrame:
    """For each pair (src, dst) its shortest undirected path, of equal ones the first by names: src, dst, path, hops, total_weight. Pairs without
    a path have no row; a vertex reaches itself in 0 hops.

    A path of two hops or more goes from a neighbour of src to a neighbour of dst, and the first of the shortest ways between these two sets depends on the sets
    alone. So ends with the same neighbours (_twins) are one class, and only pairs of classes walk: breadth first from each first class's neighbours, over half of
    the hops; per vertex only the first path stays. A class whose targets are all found stops. For the pairs that are left each second class walks the
    other way; a pair's walks meet on a vertex, and its path is the least of those put together there. So no path that is carried is longer than half, and the
    wide levels in the middle are never walked from one end. Ends and their weights are put on when all are found.
    """
    pairs = written(_undirected(edges, mentions), "pairs")
    asked = written(wanted.select("src", "dst").distinct(), "wanted")
    hops = lambda rows, n: rows.select("src", "dst", F.array_join("path", " > ").alias("path"), F.lit(n).alias("hops"), F.col("weight").alias("total_weight"))
    out = hops(asked.filter("src = dst").select("src", "dst", F.array("src").alias("path"), F.lit(0).cast("long").alias("weight")), 0)
    if max_hops < 1:
        return out
    near = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight")
    met = asked.filter("src <> dst").join(near, ["src", "dst"], "left")
    out = out.unionByName(hops(met.filter("weight IS NOT NULL").select("src", "dst", F.array("src", "dst").alias("path"), "weight"), 1))
    if max_hops < 2:
        return out
    far = met.filter("weight IS NULL").select("src", "dst")
    ends = far.select(F.col("src").alias("end")).distinct().unionByName(far.select(F.col("dst").alias("end")).distinct())
    named = written(_twins(pairs, ends), "members")
    first, last = (named.select(F.col("end").alias(e), F.col("class").alias(c)) for e, c in (("src", "first"), ("dst", "last")))
    far = written(far.join(first, "src").join(last, "dst"), "far")
    ways = written(_ways(pairs, far.select(F.col("first").alias("src"), F.col("last").alias("dst")).distinct(), max_hops - 2), "ways")
    # the weight of a way with its ends: once for each end of a class, before the pairs are met
    begin = ways.select("src", F.get("path", F.lit(0)).alias("b")).distinct().join(named, F.col("src") == F.col("class")).select(F.col("end").alias("a"), "b").join(pairs, ["a", "b"])
    finish = ways.select("dst", F.element_at("path", -1).alias("b")).distinct().join(named, F.col("dst") == F.col("class")).select(F.col("end").alias("a"), "b").join(pairs, ["a", "b"])
    found = far.join(ways.select(F.col("src").alias("first"), F.col("dst").alias("last"), "path", "weight", "hops"), ["first", "last"])
    found = found.withColumns({"x": F.get("path", F.lit(0)), "y": F.element_at("path", -1)})
    found = found.join(begin.select(F.col("a").alias("src"), F.col("b").alias("x"), F.col("weight").alias("w0")), ["src", "x"]).join(finish.select(F.col("a").alias("dst"), F.col("b").alias("y"), F.col("weight").alias("w1")), ["dst", "y"])
    path = F.array_join(F.concat(F.array("src"), "path", F.array("dst")), " > ")
    return out.unionByName(found.select("src", "dst", path.alias("path"), "hops", (F.col("w0") + F.col("weight") + F.col("w1")).alias("total_weight")))


def paths_between(edges: DataFrame, sources: DataFrame, targets: DataFrame, max_hops: int = 4, mentions: DataFrame | None = None) -> DataFrame:
    """shortest_path for all pairs of a source (src) and a target (dst), without a table of pairs: only pairs of classes (_twins) are listed.

    Vertices with the same neighbours are next to the same vertices, so a pair of classes is adjacent as a whole, or none of its members are; and members of one
    class are never adjacent. What is left is the first way between two classes with each of their ends put on (_crossed).
    """
    pairs = written(_undirected(edges, mentions), "pairs")
    src, dst = (written(df.select(c).distinct(), c) for df, c in ((sources, "src"), (targets, "dst")))
    hops = lambda rows, n: rows.select("src", "dst", F.array_join("path", " > ").alias("path"), F.lit(n).alias("hops"), F.col("weight").alias("total_weight"))
    both = src.join(dst.withColumnRenamed("dst", "src"), "src", "left_semi")
    out = hops(both.select("src", F.col("src").alias("dst"), F.array("src").alias("path"), F.lit(0).cast("long").alias("weight")), 0)
    if max_hops < 1:
        return out
    near = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight").join(src, "src", "left_semi").join(dst, "dst", "left_semi")
    out = out.unionByName(hops(near.select("src", "dst", F.array("src", "dst").alias("path"), "weight"), 1))
    if max_hops < 2:
        return out
    named = written(_twins(pairs, src.select(F.col("src").alias("end")).unionByName(dst.select(F.col("dst").alias("end")))), "members")
    first = written(named.join(src.withColumnRenamed("src", "end"), "end", "left_semi").select(F.col("end").alias("src"), F.col("class").alias("first")), "firsts")
    last = written(named.join(dst.withColumnRenamed("dst", "end"), "end", "left_semi").select(F.col("end").alias("dst"), F.col("class").alias("last")), "lasts")
    # a class is named by one of its vertices, which stands for all of them
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = first.select(F.col("first").alias("src")).distinct().repartition(parts, "src").crossJoin(last.select(F.col("last").alias("dst")).distinct())
    far = met.join(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")), ["src", "dst"], "left_anti")
    ways = written(_ways(pairs, far, max_hops - 2), "ways").withColumns({"x": F.get("path", F.lit(0)), "y": F.element_at("path", -1)})
    # an end and its weight: once for each vertex that a class's ways begin or finish with
    begin = ways.select(F.col("src").alias("first"), "x").distinct().join(first, "first").join(pairs.select(F.col("a").alias("src"), F.col("b").alias("x"), F.col("weight").alias("w0")), ["src", "x"])
    finish = ways.select(F.col("dst").alias("last"), "y").distinct().join(last, "last").join(pairs.select(F.col("a").alias("dst"), F.col("b").alias("y"), F.col("weight").alias("w1")), ["dst", "y"])
    begun = ways.withColumnsRenamed({"src": "first", "dst": "last"}).join(begin, ["first", "x"])
    begun = begun.select("src", "last", "y", "hops", F.array_join(F.concat(F.array("src"), "path", F.array(F.lit(""))), " > ").alias("path"), (F.col("w0") + F.col("weight")).alias("weight"))
    found = _crossed(begun, finish, ["last", "y"], "src", "dst").filter("src <> dst")
    return out.unionByName(found.select("src", "dst", F.concat("path", "dst").alias("path"), "hops", (F.col("weight") + F.col("w1")).alias("total_weight")))


def _ways(pairs: DataFrame, open_: DataFrame, most: int) -> DataFrame:
    """For pairs of vertices (src, dst) the first of the shortest ways, of `most` hops at most, from a neighbour of src to one of dst: src, dst, path, weight, and
    hops (two more, for the ends)."""
    open_, half, done = written(open_, "open"), -(-most // 2), []

    def start(end: str) -> DataFrame:
        ends = open_.select(end).distinct().join(pairs, F.col(end) == F.col("a"))
        return written(ends.select(end, F.col("b").alias("node"), F.array("b").alias("path"), F.lit(0).cast("long").alias("weight")), "level")

    def walk(level: DataFrame, seen: DataFrame, end: str, forward: bool) -> DataFrame:
        """The next level of the walks that are open: the vertices not seen before, each with its first path."""
        live = level.join(open_.select(end).distinct(), end, "left_semi")
        path = F.concat("path", F.array("b")) if forward else F.concat(F.array("b"), "path")
        step = live.join(pairs.withColumnRenamed("weight", "w"), F.col("node") == F.col("a")).select(end, F.col("b").alias("node"), path.alias("path"), (F.col("weight") + F.col("w")).alias("weight"))
        new = step.groupBy(end, "node").agg(F.min(F.struct("path", "weight")).alias("p")).join(seen, [end, "node"], "left_anti")
        return written(new.select(end, "node", "p.path", "p.weight"), "level")

    def settle(level: DataFrame, back: DataFrame, hop: int) -> DataFrame:
        """The pairs whose walks meet; those that are left."""
        ends = back.select("dst", "node", F.col("path").alias("rest"), F.col("weight").alias("w"))
        whole = F.struct(F.concat("path", F.slice("rest", 2, most + 1)).alias("path"), (F.col("weight") + F.col("w")).alias("weight"))
        found = open_.join(level, "src").join(ends, ["dst", "node"]).groupBy("src", "dst").agg(F.min(whole).alias("p"))
        done.append(written(found.select("src", "dst", "p.path", "p.weight", F.lit(hop + 2).alias("hops")), "ways"))
        return written(open_.join(done[-1].select("src", "dst"), ["src", "dst"], "left_anti"), "open")

    level, back = start("src"), start("dst")
    seen, met = level.select("src", "node"), back.select("dst", "node")
    for hop in range(most + 1):
        if hop and hop <= half:
            level = walk(level, seen, "src", True)
            seen = seen.unionByName(level.select("src", "node"))
        elif hop:
            back = walk(back, met, "dst", False)
            met = met.unionByName(back.select("dst", "node"))
        open_ = settle(level, back, hop)
        if open_.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def entity_documents(mentions: DataFrame, documents: DataFrame, ids: DataFrame) -> DataFrame:
    """Current documents that mention each wanted entity, newest first."""
    hits = mentions.join(ids.select("canonical"), "canonical", "left_semi")
    return hits.join(documents, "doc_id").select("canonical", "doc_id", "created_at").orderBy("canonical", F.desc("created_at"), F.desc("doc_id"))


def list_relationships(edges: DataFrame, type: str | None = None, most: int = 50) -> DataFrame:
    rows = edges if type is None else edges.filter(F.col("rel") == type)
    return rows.orderBy(F.desc("weight"), "src", "dst", "rel").limit(most)


def graph_stats(vertices: DataFrame, edges: DataFrame, mentions: DataFrame | None = None) -> DataFrame:
    """section, item, n: totals and counts by entity and relation type; with mentions they count as a relation type."""
    v = vertices.rollup("entity_type").agg(F.count(F.lit(1)).alias("n")).select(F.lit("entities").alias("section"), F.coalesce("entity_type", F.lit("all")).alias("item"), "n")
    counts = edges.groupBy("rel").agg(F.count(F.lit(1)).alias("n"))
    if mentions is not None:
        counts = counts.unionByName(mentions.agg(F.count(F.lit(1)).alias("n")).select(F.lit("MENTIONED_IN").alias("rel"), "n"))
    e = counts.rollup("rel").agg(F.sum("n").alias("n")).select(F.lit("relationships").alias("section"), F.coalesce("rel", F.lit("all")).alias("item"), "n")
    return v.unionByName(e)


# from the documents' own arrays


def _entities(documents: DataFrame) -> DataFrame:
    return documents.filter("is_current").select("doc_id", "title", "created_at", F.explode("entities").alias("e")).select("doc_id", "title", "created_at", "e.*")


def first_values(rows: DataFrame, key: list[str], value: str, most: int, separator: str) -> DataFrame:
    """The first `most` distinct values of each key, in order, as one string: a struct k of the key's columns (so that null
    keys meet) and value. Each (key, share of the values) is cut by itself before a key's values meet."""
    share = F.pmod(F.xxhash64(value), F.lit(SHARES))
    once = rows.filter(F.col(value).isNotNull()).select(F.struct(*key).alias("k"), value).distinct().withColumn("share", share)
    for by in (("k", "share"), ("k",)):
        once = once.withColumn("turn", F.row_number().over(Window.partitionBy(*by).orderBy(value))).filter(F.col("turn") <= most)
    return once.groupBy("k").agg(F.array_join(F.sort_array(F.collect_list(value)), separator).alias(value))


def entity_lookup(documents: DataFrame, pattern: str, type: str | None = None, most: int = 50) -> DataFrame:
    """Entities whose name holds the pattern: name, type, context, documents, mentions (documents where none are given), five titles."""
    rows = _entities(documents).filter(F.contains(F.lower("name"), F.lit(pattern.lower())))
    if type is not None:
        rows = rows.filter(F.col("type") == type)
    key = ["name", "type", "context"]
    # a document's mentions of an entity are summed first, so that documents are counted, not collected
    each = rows.groupBy(*key, "doc_id").agg(F.sum("mentions").alias("m"))
    out = each.groupBy(*key).agg(F.count(F.lit(1)).alias("documents"), F.sum("m").alias("m"))
    best = out.withColumn("mentions", F.coalesce("m", "documents")).orderBy(F.desc("documents"), F.desc("mentions"), *key).limit(most).withColumn("k", F.struct(*key))
    titles = first_values(rows, key, "title", 5, "|")
    found = best.join(titles, "k", "left").select(*key, "documents", "mentions", F.coalesce("title", F.lit("")).alias("titles"))
    return found.orderBy(F.desc("documents"), F.desc("mentions"), *key)


def _relationships(documents: DataFrame) -> DataFrame:
    return documents.filter("is_current").select("doc_id", "title", F.posexplode("relationships").alias("position", "r")).select("doc_id", "title", "position", "r.*")


def relationship_lookup(documents: DataFrame, pattern: str, most: int = 30) -> DataFrame:
    low = F.lit(pattern.lower())
    rows = _relationships(documents).filter(F.contains(F.lower("source"), low) | F.contains(F.lower("target"), low))
    return rows.orderBy(F.desc("confidence"), "doc_id", "position").limit(most).select("doc_id", "title", "source", "target", "type", "confidence")


def ego_network(documents: DataFrame, name: str, most: int = 50) -> DataFrame:
    """The nodes one hop from those whose name holds the given one, with their connections."""
    low = F.lit(name.lower())
    rows = _relationships(documents)
    near, far = F.contains(F.lower("source"), low), F.contains(F.lower("target"), low)
    others = rows.filter(near | far).select(F.when(near, F.col("target")).otherwise(F.col("source")).alias("node"), "type", "doc_id")
    return others.groupBy("node").agg(F.count(F.lit(1)).alias("connections"), F.array_join(F.sort_array(F.collect_set("type")), ",").alias("types")).orderBy(F.desc("connections"), "node").limit(most)


def ego_edges(documents: DataFrame, name: str, most: int = 50) -> DataFrame:
    """The edges of ego_network: the relationships with an end whose name holds the given one, the surest first."""
    low = F.lit(name.lower())
    rows = _relationships(documents).filter(F.contains(F.lower("source"), low) | F.contains(F.lower("target"), low))
    return rows.orderBy(F.desc("confidence"), "doc_id", "position").limit(most).select("source", "target", "type", "description", "confidence", "doc_id")


def entity_network(documents: DataFrame, partners: int = 5, contexts: int = 5) -> DataFrame:
    """The cross-document table: canonical name, type of the first mention, documents, mentions, the first `contexts` different contexts, and the
    entities named with it most often.

    Pairs are made of all entities of a document. Its names are cut into blocks of about PAIR_BLOCK, and each two blocks
    meet by themselves, so a long list is spread over tasks.
    """
    rows = _entities(documents).withColumn("canonical", canonical_name(F.col("name"))).filter("canonical <> ''")
    by_doc = rows.groupBy("canonical", "doc_id").agg(F.min(F.struct("created_at", "doc_id", "name", "type")).alias("f"), F.sum("mentions").alias("mentions"))
    main = by_doc.groupBy("canonical").agg(F.min("f")["type"].alias("type"), F.count(F.lit(1)).alias("documents"), F.sum("mentions").alias("mentions"))
    listed = rows.groupBy("doc_id").agg(F.collect_set("canonical").alias("names"))
    named = listed.select("doc_id", F.ceil(F.size("names") / PAIR_BLOCK).cast("int").alias("blocks"), F.explode("names").alias("name"))
    own, other = F.pmod(F.xxhash64("name"), F.col("blocks")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1))
    left = named.select("doc_id", own.alias("p"), other.alias("q"), F.col("name").alias("canonical"))
    right = named.select("doc_id", other.alias("p"), own.alias("q"), F.col("name").alias("partner"))
    half = left.join(right, ["doc_id", "p", "q"]).filter("canonical < partner").groupBy("canonical", "partner").agg(F.count(F.lit(1)).alias("n"))
    sides = F.array(F.struct("canonical", "partner"), F.struct(F.col("partner").alias("canonical"), F.col("canonical").alias("partner")))
    counts = half.select("n", F.explode(sides).alias("s")).select("s.canonical", "s.partner", "n")
    best = counts.withColumn("k", F.row_number().over(Window.partitionBy("canonical").orderBy(F.desc("n"), "partner"))).filter(F.col("k") <= partners)
    top = best.groupBy("canonical").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "partner"))), lambda x: x["partner"]), ",").alias("partners"))
    said = first_values(rows, ["canonical"], "context", contexts, "|").select("k.canonical", F.col("context").alias("contexts"))
    out = main.join(top, "canonical", "left").join(said, "canonical", "left")
    return out.select("canonical", "type", "documents", "mentions", F.coalesce("contexts", F.lit("")).alias("contexts"), F.coalesce("partners", F.lit("")).alias("partners"))


def people_directory(documents: DataFrame, shown: int = 100) -> DataFrame:
    """People merged by canonical name: roles and organisations (the first `shown` of each), first e-mail (by document), documents.
    Needs people arrays."""
    p = documents.filter("is_current").select("doc_id", F.explode("people").alias("p")).select("doc_id", "p.*").withColumn("person", canonical_name(F.col("name"))).filter("person <> ''")
    mail = F.min_by("email", F.when(F.col("email").isNotNull(), F.col("doc_id"))).alias("email")
    # a person's rows of a document are merged first, so that documents are counted, not collected
    each = p.groupBy("person", "doc_id").agg(F.min("email").alias("email"))
    out = each.groupBy("person").agg(mail, F.count(F.lit(1)).alias("documents"))
    for name in ("role", "organization"):
        listed = first_values(p, ["person"], name, shown, ",").select("k.person", name)
        out = out.join(listed, "person", "left").withColumn(name, F.coalesce(name, F.lit("")))
    return out.select("person", "role", "organization", "email", "documents")


def timeline(documents: DataFrame, most: int = 30) -> DataFrame:
    """Dates of current documents (array of date, context) by their text."""
    rows = documents.filter("is_current").select("doc_id", F.posexplode("dates").alias("position", "d")).select("doc_id", "position", "d.*")
    return rows.orderBy("date", "doc_id", "position").limit(most).select("doc_id", "date", "context")


def gather_scope(documents: DataFrame, scope: str, most: int) -> DataFrame:
    """The newest current documents, of one category for category:x, with summaries of 500."""
    rows = documents.filter("is_current")
    if scope.startswith("category:"):
        rows = rows.filter(F.col("category") == scope.removeprefix("category:"))
    return rows.orderBy(F.desc("created_at"), F.desc("doc_id")).limit(most).select("doc_id", "title", "category", F.substring("summary", 1, 500).alias("summary"))


#: How much of a document's lists goes into the digest of a scope, and into that of a folder.
SCOPE_CAPS = {"entities": 20, "people": 10, "relationships": 15, "tags": 15, "dates": 8, "metrics": 8, "cross_references": 5, "key_quotes": 3, "sections": 10}
FOLDER_CAPS = {"entities": 20, "people": 10, "relationships": 10, "tags": 10, "dates": 5, "key_quotes": 3}


def document_digest(documents: DataFrame, caps: dict[str, int], summary: int) -> DataFrame:
    """Each document's title, category, the beginning of its summary and the beginnings of those of its lists that it has; null lists are
    empty."""
    lists = [F.slice(F.coalesce(F.col(c), F.array().cast(documents.schema[c].dataType)), 1, n).alias(c) for c, n in caps.items() if c in documents.columns]
    keep = [c for c in ("doc_id", "source_file_id", "title", "category", "created_at") if c in documents.columns]
    return documents.select(*keep, F.substring(F.coalesce("summary", F.lit("")), 1, summary).alias("summary"), *lists)


def scope_digest(documents: DataFrame, scope: str, most: int) -> DataFrame:
    """The digests of a scope's newest documents (see gather_scope), with summaries of 400."""
    rows = gather_scope(documents, scope, most).select("doc_id").join(documents.filter("is_current"), "doc_id")
    return document_digest(rows, SCOPE_CAPS, 400)
