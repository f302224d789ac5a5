"""Folders: paths, counts, trees, moves, deletion, roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import let
from millrace.operators.graph import FOLDER_CAPS, document_digest
from millrace.sources.shared import written

#: Shares of a folder's names that are sorted apart.
SHARES = 64


def folder_paths(folders: DataFrame) -> DataFrame:
    """Add path (/a/b) from the chain of parents, of any depth. Folders in a cycle, or below an unknown parent, have none.

    Paths double their length in each round: a folder whose path begins at another folder takes on that folder's own path, so
    the rounds are the logarithm of the depth. Each round is written; a cycle never reaches a root, and the rounds end when
    no path has grown to its root any more.
    """
    rows = folders.select("id", F.col("parent_id").alias("above"), F.concat(F.lit("/"), "name").alias("path"))
    known = written(rows.filter("above IS NULL").select("id", "path"), "paths")
    chains = written(rows.filter("above IS NOT NULL"), "chains")
    while True:
        up = known.select(F.col("id").alias("above"), F.col("path").alias("up"))
        done = written(chains.join(up, "above").select("id", F.concat("up", "path").alias("path")), "paths")
        if done.isEmpty():
            break
        link = chains.select(F.col("id").alias("above"), F.col("above").alias("further"), F.col("path").alias("up"))
        rest = chains.join(done.select("id"), "id", "left_anti")
        longer = rest.join(link, "above", "left").select("id", F.coalesce("further", "above").alias("above"), F.concat(F.coalesce("up", F.lit("")), "path").alias("path"))
        known, chains = known.unionByName(done), written(longer, "chains")
    return folders.join(known, "id", "left")


def folder_counts(folders: DataFrame, files: DataFrame) -> DataFrame:
    """Files (not deleted) and folders directly inside each folder, zeros included."""
    f = files.filter("deleted_at IS NULL").groupBy(F.col("folder_id").alias("id")).agg(F.count(F.lit(1)).alias("f"))
    s = folders.filter("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("id")).agg(F.count(F.lit(1)).alias("s"))
    out = folders.select("id", "name").join(f, "id", "left").join(s, "id", "left")
    return out.select("id", "name", F.coalesce("f", F.lit(0)).alias("file_count"), F.coalesce("s", F.lit(0)).alias("subfolder_count"))


def folder_tree(paths: DataFrame, root: str) -> DataFrame:
    """The folders under the path root, with their depth below it; / is all."""
    top = root.rstrip("/")
    inside = paths.filter((F.col("path") == top) | F.col("path").startswith(top + "/"))
    return inside.select("id", "name", "parent_id", "path", (F.size(F.split("path", "/")) - len(top.split("/"))).alias("depth")).orderBy("path")


def ancestors(path: str = "path"):
    """All prefixes of a path that are folders, the path itself included."""
    return let(F.split(path, "/"), lambda parts: F.transform(F.sequence(F.lit(2), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")))


def move_folders(paths: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Move folders (moves: id, new_parent_id): the folders after it, and the moves refused with the reason.

    Refused: an unknown folder, into itself, into a folder below it, or beside a folder of the same name. Moves of one batch are
    seen against the tree before it. Paths below a moved folder are rewritten through an exploded ancestor list: an
    equi-join, not a prefix join.
    """
    asked = moves.join(paths.select("id", "name", F.col("path").alias("from_path")), "id", "left")
    asked = asked.join(paths.select(F.col("id").alias("new_parent_id"), F.col("path").alias("to_path")), "new_parent_id", "left")
    sibling = paths.select(F.col("parent_id").alias("new_parent_id"), "name", F.col("id").alias("other"))
    clash = asked.join(sibling, ["new_parent_id", "name"]).filter("other <> id").select("id").distinct().withColumn("clash", F.lit(True))
    asked = asked.join(clash, "id", "left")
    reason = (
        F.when(F.col("from_path").isNull() | (F.col("to_path").isNull() & F.col("new_parent_id").isNotNull()), "unknown").when(F.col("new_parent_id") == F.col("id"), "into itself")
        .when(F.col("to_path").startswith(F.concat("from_path", F.lit("/"))), "into a descendant").when(F.col("clash"), "name taken")
    )
    judged = asked.withColumn("reason", reason)
    good = judged.filter("reason IS NULL").select(F.col("id").alias("moved"), "new_parent_id", "from_path", F.concat(F.coalesce("to_path", F.lit("")), F.lit("/"), "name").alias("new_path"))
    touched = paths.select("id", F.explode(ancestors()).alias("from_path")).join(good, "from_path")
    # a folder below two moved ones follows the nearest
    nearest = touched.groupBy("id").agg(F.max_by(F.struct("moved", "new_parent_id", "from_path", "new_path"), F.length("from_path")).alias("m"))
    out = paths.join(nearest, "id", "left")
    out = out.select(
        "id", "name", F.when(F.col("m.moved") == F.col("id"), F.col("m.new_parent_id")).otherwise(F.col("parent_id")).alias("parent_id"),
        F.when(F.col("m").isNotNull(), F.concat(F.col("m.new_path"), F.expr("substring(path, length(m.from_path) + 1)"))).otherwise(F.col("path")).alias("path"),
    )
    return out, judged.filter("reason IS NOT NULL").select("id", "new_parent_id", "reason")


def delete_folders(paths: DataFrame, files: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Folders after the subtrees of ids are gone, and files, those of the subtrees at the root (folder_id null)."""
    gone = paths.join(ids.select("id"), "id", "left_semi").select(F.col("path").alias("top"))
    dead = paths.select("id", F.explode(ancestors()).alias("top")).join(gone, "top", "left_semi").select("id").distinct()
    kept = paths.join(dead, "id", "left_anti")
    moved = files.join(dead.select(F.col("id").alias("folder_id"), F.lit(True).alias("_dead")), "folder_id", "left")
    return kept, moved.withColumn("folder_id", F.when(F.col("_dead"), F.lit(None)).otherwise(F.col("folder_id"))).select(*files.columns)


def folder_digest(paths: DataFrame, files: DataFrame, titles: int = 5) -> DataFrame:
    """For every folder its whole subtree: processed files (not deleted), and the first names; deepest folders first.

    Files are counted by folder first; each count then goes to the folder's ancestors, so the tree is walked once and a large
    folder is one row. Names are cut to `titles` a folder before they go up and again on each path; what is sorted for that
    is dealt by (path, a hash) first, so the root's names meet in one task only as a few from each share.
    """
    ready = files.filter("deleted_at IS NULL AND status = 'processed'")

    def first(rows: DataFrame, *key: str) -> DataFrame:
        turn = F.row_number().over(Window.partitionBy(*key).orderBy("filename"))
        return rows.withColumn("turn", turn).filter(F.col("turn") <= titles).drop("turn")

    share = F.pmod(F.xxhash64("filename"), F.lit(SHARES))
    own = first(first(ready.select(F.col("folder_id").alias("id"), "filename", share.alias("share")), "id", "share"), "id")
    up = paths.join(own, "id").select(F.explode(ancestors()).alias("path"), "filename", "share")
    names = first(first(up, "path", "share"), "path").groupBy("path").agg(F.array_join(F.sort_array(F.collect_list("filename")), ",").alias("files"))
    counts = ready.groupBy(F.col("folder_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    sums = paths.join(counts, "id").select(F.explode(ancestors()).alias("path"), "n").groupBy("path").agg(F.sum("n").alias("n"))
    out = paths.select("id", "path").join(sums, "path", "left").join(names, "path", "left")
    depth = (F.size(F.split("path", "/")) - 1).alias("depth")
    return out.select("id", "path", F.coalesce("n", F.lit(0)).alias("file_count"), F.coalesce("files", F.lit("")).alias("files"), depth).orderBy(F.desc("depth"), "path")


def _running(rows: DataFrame, order: list[str], value: str) -> DataFrame:
    """Add before: the sum of value over all rows in front, by order. Rows are dealt by ranges; a window stands over one range, and another over one
    row a range."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    front = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("_part").agg(F.sum(value).alias("_sum")).select("_part", F.coalesce(F.sum("_sum").over(front), F.lit(0)).alias("_front"))
    inside = F.coalesce(F.sum(value).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn("_inside", inside).join(F.broadcast(offsets), "_part").withColumn("before", F.col("_front") + F.col("_inside")).drop("_part", "_front", "_inside")


def folder_intervals(paths: DataFrame) -> DataFrame:
    """Each folder's place in a walk that visits a folder before what is in it, siblings by name, and the last place inside it: id, path, place, last.
    A subtree is the range from place to last. Folders without a path have no row."""
    walk = paths.filter("path IS NOT NULL").select("id", "path", F.split("path", "/").alias("key"), F.lit(1).cast("long").alias("one"))
    placed = _running(walk, ["key", "id"], "one").select("id", "path", (F.col("before") + 1).alias("place"))
    sizes = placed.select(F.explode(ancestors()).alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("size"))
    return placed.join(sizes, "path").select("id", "path", "place", (F.col("place") + F.col("size") - 1).alias("last"))


def subtree_sums(intervals: DataFrame, values: DataFrame) -> DataFrame:
    """Sums of values (id, n) over each folder's whole subtree: id, n. The values' running sum by place is read at a subtree's two ends, so a folder
    costs two lookups, however deep it lies or however much is in it."""
    intervals = written(intervals, "intervals")
    own = intervals.join(values.groupBy("id").agg(F.sum("n").alias("n")), "id", "left").select("place", F.coalesce("n", F.lit(0)).alias("n"))
    sums = written(_running(own, ["place"], "n").select("place", "before", (F.col("before") + F.col("n")).alias("upto")), "running")
    ends = intervals.join(sums.select("place", "before"), "place").join(sums.select(F.col("place").alias("last"), "upto"), "last")
    return ends.select("id", (F.col("upto") - F.col("before")).alias("n"))


def folder_documents(paths: DataFrame, files: DataFrame, documents: DataFrame) -> DataFrame:
    """For every folder the digests (see document_digest) of the current documents of its whole subtree's processed files that are not
    deleted: id, depth, then the digest. A document is cut down once, where it lies; then a row goes to each folder above
    it, which is the result's own size. Folders are met by id, in a table of folders and the folders above them."""
    ready = files.filter("deleted_at IS NULL AND status = 'processed'").select(F.col("file_id").alias("source_file_id"), "folder_id")
    digests = document_digest(documents.filter("is_current"), FOLDER_CAPS, 500)
    above = paths.select(F.col("id").alias("folder_id"), F.explode(ancestors()).alias("path")).join(paths.select("id", "path", (F.size(F.split("path", "/")) - 1).alias("depth")), "path")
    return digests.join(ready, "source_file_id").join(above.select("folder_id", "id", "depth"), "folder_id").select("id", "depth", *digests.columns)


def folder_contents(folders: DataFrame, files: DataFrame, links: DataFrame) -> DataFrame:
    """What each folder shows: folder_id (null: the root), kind, id, name, tags, and the place in its list: folders by name, then files
    that are not deleted, newest first."""
    tags = links.groupBy("file_id").agg(F.array_join(F.sort_array(F.collect_set("name")), ",").alias("tags"))
    inner = folders.select(F.col("parent_id").alias("folder_id"), F.lit("folder").alias("kind"), F.col("id").cast("string").alias("id"), "name", F.lit("").alias("tags"), F.lit(None).cast("timestamp").alias("at"))
    held = files.filter("deleted_at IS NULL").join(tags, "file_id", "left")
    rows = inner.unionByName(held.select("folder_id", F.lit("file").alias("kind"), F.col("file_id").cast("string").alias("id"), F.col("filename").alias("name"), F.coalesce("tags", F.lit("")).alias("tags"), F.col("created_at").alias("at")))
    return rows.orderBy("folder_id", F.desc("kind"), F.desc("at"), "name", "id")


def move_files(files: DataFrame, moves: DataFrame, folders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files after moves (file_id, target; null: the root), and the moves whose folder is unknown."""
    known = moves.join(folders.select(F.col("id").alias("target"), F.lit(True).alias("known")), "target", "left").withColumn("known", F.coalesce("known", F.col("target").isNull()))
    good = known.filter("known").select("file_id", "target", F.lit(True).alias("_moved"))
    out = files.join(good, "file_id", "left").withColumn("folder_id", F.when(F.col("_moved"), F.col("target")).otherwise(F.col("folder_id")))
    return out.select(*files.columns), known.filter("NOT known").select("file_id", "target")


def resolve_paths(wanted: DataFrame, paths: DataFrame, files: DataFrame) -> DataFrame:
    """Files for full paths (/folder/file): path, file_id; null where there is none."""
    split = wanted.select("path", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("parent"), F.substring_index("path", "/", -1).alias("filename"))
    at = paths.select("id", F.col("path").alias("parent"))
    live = files.filter("deleted_at IS NULL").select("file_id", "filename", F.col("folder_id").alias("id"))
    return split.join(at, "parent", "left").join(live, ["id", "filename"], "left").select("path", "file_id")
