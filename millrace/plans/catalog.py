"""Queries over files, folders and statistics, with their oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from millrace.operators import folders as J
from millrace.operators import registry as B
from millrace.operators import stats as H
from millrace.plans import testbed as t
from millrace.sources import skipping as X
from millrace.sources.shared import shared_dir, written
from millrace.plans.network import _LISTS, shown, with_lists
from millrace.plans.testbed import with_tables

Q, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def _tags(spark, sf):
    return t.read(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), F.explode(F.array(F.lower("lang"), F.lower("source"))).alias("name")).distinct()


_LINKS = "links AS (SELECT DISTINCT doc_id AS file_id, unnest([lower(lang), lower(source)]) AS name FROM documents)"


@query("register_files", with_tables("files", more="""held AS (SELECT sha256, min(file_id) AS held_id FROM files WHERE file_id % 3 = 0 AND deleted_at IS NULL GROUP BY 1),
fresh AS (SELECT * FROM files WHERE file_id % 3 <> 0), firsts AS (SELECT sha256, arg_min(file_id, (created_at, file_id)) AS first_id FROM fresh WHERE size_bytes > 0 GROUP BY 1)""") + """
SELECT file_id, v AS verdict, CASE WHEN v = 'duplicate' THEN coalesce(held_id, first_id) END AS existing_id FROM (
  SELECT fresh.*, held_id, first_id, CASE WHEN size_bytes <= 0 THEN 'empty' WHEN held_id IS NOT NULL OR first_id <> file_id THEN 'duplicate' ELSE 'registered' END AS v
  FROM fresh LEFT JOIN firsts USING (sha256) LEFT JOIN held USING (sha256))""")  # fmt: skip
def register_files(spark, sf):
    files = t.files(spark, sf)
    return B.register_files(files.filter("file_id % 3 <> 0"), files.filter("file_id % 3 = 0")).select("file_id", "verdict", "existing_id")


@query("detect_changes", with_tables("files") + """
SELECT coalesce(c.path, p.path) AS path, CASE WHEN c.path IS NULL THEN 'gone' WHEN coalesce(p.size_bytes, 0) = 0 THEN 'full' WHEN p.sha256 IS NOT DISTINCT FROM c.sha256 THEN 'skip' ELSE 'incremental' END AS action
FROM (SELECT filename AS path, size_bytes, sha256 FROM files WHERE file_id % 7 <> 0) p FULL JOIN
     (SELECT filename AS path, size_bytes, CASE WHEN file_id % 10 = 0 THEN 'x' ELSE sha256 END AS sha256 FROM files WHERE file_id % 11 <> 0) c ON p.path = c.path""")
def detect_changes(spark, sf):
    files = t.files(spark, sf).withColumnRenamed("filename", "path")
    later = files.filter("file_id % 11 <> 0").withColumn("sha256", F.when(F.expr("file_id % 10 = 0"), "x").otherwise(F.col("sha256")))
    return B.detect_changes(files.filter("file_id % 7 <> 0"), later)


@query("soft_delete", with_tables("files") + """SELECT file_id, CASE WHEN file_id % 4 = 0 AND deleted_at IS NULL THEN 'deleting' ELSE status END AS status,
CASE WHEN file_id % 4 = 0 AND deleted_at IS NULL THEN TIMESTAMP '2024-07-01 00:00:00' ELSE deleted_at END AS deleted_at FROM files""")
def soft_delete(spark, sf):
    files = t.files(spark, sf)
    return B.soft_delete(files, files.filter("file_id % 4 = 0"), F.expr("timestamp'2024-07-01 00:00:00'")).select("file_id", "status", "deleted_at")


@query("reprocess_queue", with_tables("files", "docs") + """SELECT file_id, 'pending' AS status FROM files WHERE status IN ('processed', 'failed') AND deleted_at IS NULL
AND file_id IN (SELECT source_file_id FROM docs WHERE is_current AND version < 2)""")
def reprocess_queue(spark, sf):
    return B.reprocess_queue(t.files(spark, sf), t.docs(spark, sf), 2).select("file_id", "status")


_NAMES = "concat(' ', upper(lang), ' , ', source, ',, Extra ', doc_id % 3)"


@query("upsert_tags", """WITH n AS (SELECT DISTINCT file_id, substr(lower(trim(x)), 1, 100) AS name FROM (SELECT doc_id AS file_id, unnest(string_split(concat(' ', upper(lang), ' , ', source, ',, Extra ', doc_id % 3), ',')) AS x FROM documents) WHERE trim(x) <> ''),
links AS (SELECT doc_id AS file_id, lower(lang) AS name FROM documents)
SELECT 'tag' AS kind, NULL::BIGINT AS file_id, name FROM (SELECT DISTINCT name FROM n WHERE name NOT IN (SELECT name FROM links))
UNION ALL SELECT 'link', file_id, name FROM n ANTI JOIN links USING (file_id, name)""")
def upsert_tags(spark, sf):
    docs = t.read(spark, sf, "documents")
    links = docs.select(F.col("doc_id").alias("file_id"), F.lower("lang").alias("name"))
    made, names = B.upsert_tags(links.select("name").distinct(), docs.select(F.col("doc_id").alias("file_id"), F.expr(_NAMES).alias("names")))
    added = B.new_links(names, links).select(F.lit("link").alias("kind"), "file_id", "name")
    return made.select(F.lit("tag").alias("kind"), F.lit(None).cast("long").alias("file_id"), "name").unionByName(added)


@query("replace_tags", f"""WITH {_LINKS}, wanted AS (SELECT doc_id AS file_id, CASE WHEN doc_id % 2 = 0 THEN 'en' ELSE 'nowhere' END AS name FROM documents WHERE doc_id % 5 = 0), tags AS (SELECT DISTINCT name FROM links)
SELECT 'link' AS kind, file_id, name FROM links WHERE file_id NOT IN (SELECT file_id FROM wanted) UNION ALL SELECT 'link', file_id, name FROM wanted WHERE name IN (SELECT name FROM tags)
UNION ALL SELECT 'error', file_id, name FROM wanted WHERE name NOT IN (SELECT name FROM tags)""")
def replace_tags(spark, sf):
    links = _tags(spark, sf)
    wanted = t.read(spark, sf, "documents").filter("doc_id % 5 = 0").selectExpr("doc_id AS file_id", "CASE WHEN doc_id % 2 = 0 THEN 'en' ELSE 'nowhere' END AS name")
    after, errors = B.replace_tags(links, wanted, links.select("name").distinct())
    return after.withColumn("kind", F.lit("link")).unionByName(errors.withColumn("kind", F.lit("error")))


@query("tag_counts", f"""WITH {_LINKS}, tags AS (SELECT DISTINCT name FROM links UNION ALL SELECT 'unused') SELECT name, count(file_id) AS file_count FROM tags LEFT JOIN links USING (name) GROUP BY name""")
def tag_counts(spark, sf):
    links = _tags(spark, sf)
    return B.tag_counts(links.select("name").distinct().unionByName(spark.range(1).select(F.lit("unused").alias("name"))), links)


@query("list_files", with_tables("files") + """, p AS (SELECT * FROM files WHERE deleted_at IS NULL AND status = 'processed' AND content_type = 'text/plain' AND file_id IN (SELECT doc_id FROM documents WHERE lower(lang) = 'en')
  AND (created_at, file_id) < (TIMESTAMP '2024-01-01 05:00:00', 300) ORDER BY created_at DESC, file_id DESC LIMIT 21)
SELECT file_id, filename, created_at, (SELECT count(*) > 20 FROM p) AS has_more FROM p ORDER BY created_at DESC, file_id DESC LIMIT 20""".replace(", p AS", "\n, p AS", 1))
def list_files(spark, sf):
    tagged = _tags(spark, sf).filter("name = 'en'")
    page = B.list_rows(t.files(spark, sf), "created_at", "file_id", 20, after=B.encode_cursor("2024-01-01 05:00:00", 300), equal={"status": "processed", "content_type": "text/plain"}, tagged=tagged)
    return page.select("file_id", "filename", "created_at", "has_more")


@query("list_documents", with_tables("docs") + """SELECT doc_id, title, created_at, (SELECT count(*) FROM docs WHERE is_current AND category = 'business') > 25 AS has_more FROM docs WHERE is_current AND category = 'business' ORDER BY created_at, doc_id LIMIT 25""")
def list_documents(spark, sf):
    return B.list_rows(t.docs(spark, sf), "created_at", "doc_id", 25, descending=False, equal={"category": "business", "is_current": True}).select("doc_id", "title", "created_at", "has_more")


# statistics


@query("collection_stats", with_tables("docs", "chunks") + """SELECT 'total' AS section, 'documents' AS item, count(*) AS n FROM docs WHERE is_current UNION ALL SELECT 'total', 'chunks', count(*) FROM chunks UNION ALL SELECT 'total', 'citations', count(*) FROM chunks
UNION ALL SELECT 'category', category, count(*) FROM docs WHERE is_current GROUP BY category
UNION ALL SELECT * FROM (SELECT 'month', strftime(date_trunc('month', created_at), '%Y-%m') AS m, count(*) FROM docs WHERE is_current GROUP BY 2 ORDER BY 2 LIMIT 12)""")
def collection_stats(spark, sf):
    chunks = t.chunks(spark, sf)
    return H.collection_stats(t.docs(spark, sf), chunks, chunks)


@query("category_counts", with_tables("docs") + "SELECT category, count(*) AS n FROM docs WHERE is_current GROUP BY category")
def category_counts(spark, sf):
    return H.category_counts(t.docs(spark, sf))


@query("entity_mention_counts", with_tables("ents") + "SELECT name, type, count(*) AS n FROM ents WHERE is_current GROUP BY name, type")
def entity_mention_counts(spark, sf):
    return H.entity_mention_counts(t.entities(spark, sf))


@query("file_status_counts", with_tables("files") + "SELECT status, count(*) AS n FROM files WHERE deleted_at IS NULL GROUP BY ROLLUP (status)")
def file_status_counts(spark, sf):
    return H.file_status_counts(t.files(spark, sf))


@query("lake_overview", with_tables("files", "docs", more=_LINKS) + """SELECT (SELECT count(*) FROM files WHERE deleted_at IS NULL) AS files, (SELECT count(*) FROM docs WHERE is_current) AS documents,
(SELECT string_agg(c, ',' ORDER BY c) FROM (SELECT DISTINCT category AS c FROM docs WHERE is_current)) AS categories, (SELECT string_agg(c, ',' ORDER BY c) FROM (SELECT DISTINCT name AS c FROM links)) AS tags""")
def lake_overview(spark, sf):
    return H.lake_overview(t.files(spark, sf), t.docs(spark, sf), _tags(spark, sf))


# folders


def _paths(spark, sf):
    return J.folder_paths(t.folders(spark, sf))


@query("folder_paths", with_tables("paths") + "SELECT id, path FROM paths")
def folder_paths(spark, sf):
    return _paths(spark, sf).select("id", "path")


@query("folder_counts", with_tables("folders", "folder_files") + """SELECT id, name, (SELECT count(*) FROM folder_files f WHERE f.folder_id = folders.id AND deleted_at IS NULL) AS file_count,
(SELECT count(*) FROM folders s WHERE s.parent_id = folders.id) AS subfolder_count FROM folders""")
def folder_counts(spark, sf):
    return J.folder_counts(t.folders(spark, sf), t.folder_files(spark, sf))


@query("folder_tree", with_tables("paths") + "SELECT id, name, parent_id, path, (len(string_split(path, '/')) - 2)::INT AS depth FROM paths WHERE path = '/ASIA' OR path LIKE '/ASIA/%'")
def folder_tree(spark, sf):
    return J.folder_tree(_paths(spark, sf), "/ASIA")


_MOVES = "SELECT id, CASE WHEN id LIKE 'c%' THEN 'n3' WHEN id = 'n8' THEN 'r0' WHEN id = 'n9' THEN 'n9' ELSE 'c1' END AS new_parent_id FROM folders WHERE id IN ('n8', 'n9', 'n3', 'r4') OR (id LIKE 'c%' AND substr(id, 2)::INT % 50 = 0)"


@query("move_folders", with_tables("paths", more=f"moves AS ({_MOVES})") + """
, a AS (SELECT m.id, m.new_parent_id, p.name, p.path AS fp, q.path AS tp, EXISTS (SELECT 1 FROM paths s WHERE s.parent_id = m.new_parent_id AND s.name = p.name AND s.id <> m.id) AS clash FROM moves m JOIN paths p ON p.id = m.id LEFT JOIN paths q ON q.id = m.new_parent_id),
j AS (SELECT *, CASE WHEN new_parent_id = id THEN 'into itself' WHEN starts_with(tp, fp || '/') THEN 'into a descendant' WHEN clash THEN 'name taken' END AS reason FROM a),
g AS (SELECT id AS moved, new_parent_id, fp, tp || '/' || name AS np FROM j WHERE reason IS NULL),
w AS (SELECT p.id, p.name, p.parent_id, p.path, g.*, row_number() OVER (PARTITION BY p.id ORDER BY length(fp) DESC) AS k FROM paths p LEFT JOIN g ON p.path = fp OR starts_with(p.path, fp || '/'))
SELECT 'folder' AS kind, id, CASE WHEN moved = id THEN new_parent_id ELSE parent_id END AS parent_id, CASE WHEN moved IS NULL THEN path ELSE np || substr(path, length(fp) + 1) END AS detail FROM w WHERE k = 1
UNION ALL SELECT 'refused', id, new_parent_id, reason FROM j WHERE reason IS NOT NULL""")
def move_folders(spark, sf):
    paths = _paths(spark, sf)
    moves = paths.filter("id IN ('n8', 'n9', 'n3', 'r4') OR (id LIKE 'c%' AND int(substring(id, 2)) % 50 = 0)").selectExpr("id", "CASE WHEN id LIKE 'c%' THEN 'n3' WHEN id = 'n8' THEN 'r0' WHEN id = 'n9' THEN 'n9' ELSE 'c1' END AS new_parent_id")
    after, refused = J.move_folders(paths, moves)
    return after.select(F.lit("folder").alias("kind"), "id", "parent_id", F.col("path").alias("detail")).unionByName(refused.select(F.lit("refused").alias("kind"), "id", F.col("new_parent_id").alias("parent_id"), F.col("reason").alias("detail")))


@query("delete_folders", with_tables("paths", "folder_files", more="dead AS (SELECT id FROM paths WHERE path = '/AFRICA' OR path LIKE '/AFRICA/%' OR path = '/ASIA/CHINA' OR path LIKE '/ASIA/CHINA/%')") + """
SELECT 'folder' AS kind, id, parent_id AS at FROM paths WHERE id NOT IN (SELECT id FROM dead) UNION ALL SELECT 'file', file_id::VARCHAR, CASE WHEN folder_id NOT IN (SELECT id FROM dead) THEN folder_id END FROM folder_files""")
def delete_folders(spark, sf):
    paths = _paths(spark, sf)
    kept, files = J.delete_folders(paths, t.folder_files(spark, sf), paths.filter("path IN ('/AFRICA', '/ASIA/CHINA')"))
    return kept.select(F.lit("folder").alias("kind"), "id", F.col("parent_id").alias("at")).unionByName(files.select(F.lit("file").alias("kind"), F.col("file_id").cast("string").alias("id"), F.col("folder_id").alias("at")))


@query("folder_digest", with_tables("paths", "folder_files", more="""f AS (SELECT filename, string_split(path, '/') AS parts FROM folder_files JOIN paths ON folder_id = id WHERE deleted_at IS NULL AND status = 'processed'),
up AS (SELECT filename, array_to_string(parts[1:n], '/') AS path FROM (SELECT filename, parts, unnest(range(2, len(parts) + 1)) AS n FROM f)),
sums AS (SELECT path, count(*) AS n, array_to_string(list_sort(list(filename))[1:5], ',') AS files FROM up GROUP BY path)""") + """
SELECT id, paths.path, coalesce(n, 0) AS file_count, coalesce(files, '') AS files, (len(string_split(paths.path, '/')) - 1)::INT AS depth FROM paths LEFT JOIN sums ON paths.path = sums.path""")
def folder_digest(spark, sf):
    return J.folder_digest(_paths(spark, sf), t.folder_files(spark, sf))


@query("folder_documents", with_tables("paths", "folder_files", "docs", "ents", "rels", more="""f AS (SELECT file_id, string_split(path, '/') AS parts FROM folder_files JOIN paths ON folder_id = id WHERE deleted_at IS NULL AND status = 'processed'),
up AS (SELECT file_id, array_to_string(parts[1:n], '/') AS path FROM (SELECT file_id, parts, unnest(range(2, len(parts) + 1)) AS n FROM f))""") + _LISTS.format(n=10) + """
SELECT paths.id, (len(string_split(up.path, '/')) - 1)::INT AS depth, doc_id, title, category, substr(summary, 1, 500) AS summary, coalesce(entities, '') AS entities, coalesce(relationships, '') AS relationships
FROM up JOIN paths ON up.path = paths.path JOIN docs ON docs.source_file_id = up.file_id AND docs.is_current LEFT JOIN e USING (doc_id) LEFT JOIN r USING (doc_id)""")
def folder_documents(spark, sf):
    found = J.folder_documents(_paths(spark, sf), t.folder_files(spark, sf), with_lists(spark, sf))
    return found.select("id", "depth", "doc_id", "title", "category", "summary", *shown(found))


_FTAGS = "ftags AS (SELECT o_orderkey AS file_id, lower(o_orderpriority) AS name FROM orders UNION ALL SELECT o_orderkey, lower(o_orderstatus) FROM orders)"


@query("folder_contents", with_tables("folders", "folder_files", more=_FTAGS) + """SELECT parent_id AS folder_id, 'folder' AS kind, id, name, '' AS tags, NULL::TIMESTAMP AS at FROM folders
UNION ALL SELECT folder_id, 'file', file_id::VARCHAR, filename, coalesce(g.tags, ''), created_at FROM folder_files LEFT JOIN (SELECT file_id, string_agg(DISTINCT name, ',' ORDER BY name) AS tags FROM ftags GROUP BY 1) g USING (file_id) WHERE deleted_at IS NULL""")
def folder_contents(spark, sf):
    orders = t.read(spark, sf, "orders")
    links = orders.selectExpr("o_orderkey AS file_id", "lower(o_orderpriority) AS name").unionByName(orders.selectExpr("o_orderkey AS file_id", "lower(o_orderstatus) AS name"))
    return J.folder_contents(t.folders(spark, sf), t.folder_files(spark, sf), links)


@query("move_files", with_tables("folder_files", "folders", more="m AS (SELECT file_id, CASE file_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'n1' ELSE 'zzz' END AS target FROM folder_files WHERE file_id % 5 = 0)") + """
SELECT 'file' AS kind, f.file_id, CASE WHEN m.file_id IS NOT NULL AND (target IS NULL OR target = 'n1') THEN target ELSE folder_id END AS folder_id FROM folder_files f LEFT JOIN m USING (file_id)
UNION ALL SELECT 'error', file_id, target FROM m WHERE target = 'zzz'""")
def move_files(spark, sf):
    files = t.folder_files(spark, sf)
    moves = files.filter("file_id % 5 = 0").selectExpr("file_id", "CASE file_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'n1' ELSE 'zzz' END AS target")
    after, errors = J.move_files(files, moves, t.folders(spark, sf))
    return after.select(F.lit("file").alias("kind"), "file_id", "folder_id").unionByName(errors.select(F.lit("error").alias("kind"), "file_id", F.col("target").alias("folder_id")))


@query("resolve_paths", with_tables("paths", "folder_files", more="w AS (SELECT path || '/' || filename AS full_path, file_id, deleted_at FROM folder_files JOIN paths ON folder_id = id)") + """
SELECT full_path AS path, CASE WHEN deleted_at IS NULL THEN file_id END AS file_id FROM w UNION ALL SELECT full_path || 'x', NULL FROM w""")
def resolve_paths(spark, sf):
    paths, files = _paths(spark, sf), t.folder_files(spark, sf)
    full = files.join(paths.select(F.col("id").alias("folder_id"), "path"), "folder_id").select(F.concat_ws("/", "path", "filename").alias("path"))
    return J.resolve_paths(full.unionByName(full.select(F.concat("path", F.lit("x")).alias("path"))), paths, files)


@query("indexed_lookup", with_tables("docs") + "SELECT doc_id, source_file_id, version, sha256(body) AS hash FROM docs WHERE source_file_id IN (10, 11, 137, 990, 5000000)")
def indexed_lookup(spark, sf):
    """The versions of a few files, from a table of 16 files with an index of ranges and Bloom filters."""
    path = f"{shared_dir(spark)}/clustered-{uuid.uuid4().hex}"
    X.write_clustered(t.docs(spark, sf), path, "doc_id", 16)
    index = written(X.index_files(spark, path, ["doc_id", "source_file_id"]), "file-index")
    found = X.lookup(spark, path, index, "source_file_id", [10, 11, 137, 990, 5_000_000])
    return found.select("doc_id", "source_file_id", "version", F.sha2("body", 256).alias("hash"))


@query("folder_intervals", with_tables("paths", "folder_files", more="""o AS (SELECT id, path, row_number() OVER (ORDER BY string_split(path, '/'), id) AS place FROM paths), n AS (SELECT folder_id AS id, count(*) AS n FROM folder_files WHERE deleted_at IS NULL GROUP BY 1),
d AS (SELECT o.id, o.place, p.place AS inner_place, coalesce(n, 0) AS n FROM o JOIN paths x ON o.id = x.id JOIN o p ON p.path = o.path OR starts_with(p.path, o.path || '/') LEFT JOIN n ON n.id = p.id)""") + """
SELECT id, place, max(inner_place) AS last, sum(n)::BIGINT AS n FROM d GROUP BY 1, 2""")
def folder_intervals(spark, sf):
    """Folders as ranges, and the files that are not deleted in each whole subtree."""
    intervals = written(J.folder_intervals(_paths(spark, sf)), "intervals")
    files = t.folder_files(spark, sf).filter("deleted_at IS NULL").groupBy(F.col("folder_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return intervals.select("id", "place", "last").join(J.subtree_sums(intervals, files), "id")
