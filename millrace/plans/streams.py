"""The streaming jobs as queries: each replays its table, takes all that is there and returns what came out."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from millrace.plans import testbed as t
from millrace.functions.text import content_hash, count_tokens, hard_split
from millrace.plans.testbed import CHUNK_TOKENS, with_tables
from millrace.plans.texts import _COUNTS, _GREEDY
from millrace.plans.usage import _OPENED
from millrace.sources.shared import shared_dir
from millrace.streaming import jobs as N
from millrace.streaming import stateful as W
from millrace.streaming import uploads as U

Q, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def _replayed(spark, rows, name):
    """rows written to the shared folder, and that folder as a stream; with a place for checkpoints."""
    base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(f"{base}/in")
    return N.read_stream(spark, f"{base}/in", spark.read.parquet(f"{base}/in").schema), base


def _collected(stream, base, mode="append"):
    stream.writeStream.outputMode(mode).format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/check").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{base}/out")


def _progress(spark, sf):
    return t.read(spark, sf, "events").selectExpr("user_id AS file_id", "CASE event_type WHEN 'purchase' THEN 'complete' ELSE event_type END AS stage", "CAST(value AS int) AS progress", "CAST(ts AS timestamp) AS at")


@query("progress_stream")
def progress_stream(spark, sf):
    stream, base = _replayed(spark, _progress(spark, sf), "progress")
    return _collected(N.progress_stream(stream), base)


@query("dashboard_stream", with_tables("files") + "SELECT status, count(*) AS n FROM files WHERE deleted_at IS NULL GROUP BY status")
def dashboard_stream(spark, sf):
    stream, base = _replayed(spark, t.files(spark, sf).filter("deleted_at IS NULL").select("file_id", "status"), "dashboard")
    name = f"dashboard_{uuid.uuid4().hex}"
    N.dashboard_stream(stream, name, None, f"{base}/check").awaitTermination()
    return spark.table(name)


@query("ledger_stream", with_tables("ledger") + """SELECT * FROM (SELECT date_trunc('hour', created_at) AS hour, caller_service, provider, model, count(*) AS requests, sum(total_tokens)::BIGINT AS total_tokens, count(*) FILTER (status <> 'success') AS errors, count(fallback_from) AS fallbacks
FROM ledger GROUP BY ALL) WHERE hour + INTERVAL 1 HOUR <= (SELECT max(created_at) - INTERVAL 10 MINUTE FROM ledger)""")
def ledger_stream(spark, sf):
    """The windows that the watermark has closed."""
    stream, base = _replayed(spark, t.ledger(spark, sf), "ledger")
    return _collected(N.ledger_stream(stream), base)


@query("ingest_stream", """WITH f AS (SELECT min(doc_id) AS doc_id FROM documents WHERE text <> '' GROUP BY sha256(text)), w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IN (SELECT doc_id FROM f))
SELECT doc_id, i::INT AS chunk_index, sha256(array_to_string(w[i * 256 + 1 : (i + 1) * 256], ' ')) AS hash, len(w[i * 256 + 1 : (i + 1) * 256])::INT AS token_count FROM (SELECT *, unnest(range(0, (len(w) + 255) // 256)) AS i FROM w)""")
def ingest_stream(spark, sf):
    stream, base = _replayed(spark, t.read(spark, sf, "documents").select("doc_id", "text"), "ingest")
    N.ingest_stream(stream, f"{base}/lake", f"{base}/check").awaitTermination()
    return N.current_chunks(spark, f"{base}/lake").select("doc_id", "chunk_index", F.sha2("content", 256).alias("hash"), "token_count")


_SECOND = "CASE WHEN doc_id % 10 = 0 THEN replace(text, ' the ', ' that ') || ' An added sentence stands here.' ELSE text END"


def _pieces(extracted):
    """Chunks of a fixed number of tokens."""
    body = F.array_join(F.transform("blocks", lambda b: b["content"]), "\n\n")
    rows = extracted.select("file_id", F.posexplode(hard_split(body, CHUNK_TOKENS)).alias("chunk_index", "content"))
    return rows.select("file_id", "chunk_index", "content", F.lit(None).cast("string").alias("source_locator"), count_tokens(F.col("content")).alias("token_count"), content_hash(F.col("content")).alias("content_hash"))


@query("upload_stream", with_tables("chunks", "chunks2", more=_GREEDY) + _COUNTS + f""", one AS (SELECT min(doc_id) AS doc_id, sha256(text) AS sha FROM documents WHERE text <> '' GROUP BY 2),
two AS (SELECT min(doc_id) AS doc_id, sha FROM (SELECT doc_id, sha256({_SECOND}) AS sha FROM documents WHERE doc_id % 10 = 0 AND text <> '') WHERE sha NOT IN (SELECT sha FROM one) GROUP BY sha),
v AS (SELECT doc_id, 1 AS version, text FROM documents WHERE doc_id IN (SELECT doc_id FROM one) UNION ALL SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM one) THEN 2 ELSE 1 END, {_SECOND} FROM documents WHERE doc_id IN (SELECT doc_id FROM two)),
b AS (SELECT doc_id, version, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS body FROM v)
SELECT 'version' AS kind, doc_id AS file_id, version, sha256(body) AS hash, NULL::BIGINT AS unchanged, NULL::BIGINT AS changed, NULL AS justification FROM b
UNION ALL SELECT 'delta', doc_id, 2, NULL, unchanged, modified + added + removed, NULL FROM c JOIN b USING (doc_id) WHERE version = 2
UNION ALL SELECT 'diff', doc_id, 1, NULL, NULL, NULL, 'Initial processing' FROM b WHERE version = 1
UNION ALL SELECT 'diff', doc_id, 2, NULL, NULL, NULL, 'Reprocessed: ' || modified || ' modified, ' || added || ' added, ' || removed || ' removed' FROM c JOIN b USING (doc_id) WHERE version = 2 AND modified + added + removed > 0
UNION ALL SELECT 'reused', n.doc_id, version, NULL, count(*), NULL, NULL FROM chunks2 n JOIN b ON b.doc_id = n.doc_id AND version = 2 WHERE (n.doc_id, n.content_hash) IN (SELECT (doc_id, content_hash) FROM chunks) GROUP BY 2, 3""")
def upload_stream(spark, sf):
    """All documents are uploaded, then a changed text of every tenth: versions, deltas, diffs and chunks whose work was kept."""
    docs = t.read(spark, sf, "documents").filter("text IS NOT NULL")
    changed = F.concat(F.replace("text", F.lit(" the "), F.lit(" that ")), F.lit(" An added sentence stands here."))
    rounds = docs, docs.filter("doc_id % 10 = 0 AND text <> ''").withColumn("text", changed)
    base = f"{shared_dir(spark)}/uploads-{uuid.uuid4().hex}"
    for rows in rounds:
        sent = rows.select(F.col("doc_id").alias("file_id"), F.concat(F.lit("document-"), "doc_id", F.lit(".txt")).alias("filename"), F.lit("text/plain").alias("content_type"), F.col("text").alias("content"))
        sent.write.mode("append").option("compression", "zstd").parquet(f"{base}/in")
        U.upload_stream(N.read_stream(spark, f"{base}/in", sent.schema), f"{base}/lake", f"{base}/check", chunker=_pieces).awaitTermination()
    lake = {name: U.read_lake(spark, f"{base}/lake", name) for name in U.TABLES}
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    counts = none("long", "unchanged"), none("long", "changed")
    out = lake["documents"].select(F.lit("version").alias("kind"), "file_id", "version", F.sha2("body", 256).alias("hash"), *counts, none("string", "justification"))
    out = out.unionByName(lake["deltas"].select(F.lit("delta").alias("kind"), "file_id", "version", none("string", "hash"), "unchanged", (F.col("modified") + F.col("added") + F.col("removed")).alias("changed"), none("string", "justification")))
    out = out.unionByName(lake["diffs"].select(F.lit("diff").alias("kind"), "file_id", "version", none("string", "hash"), *counts, "justification"))
    kept = lake["chunks"].filter("reused").groupBy("file_id", "version").agg(F.count(F.lit(1)).alias("unchanged"))
    return out.unionByName(kept.select(F.lit("reused").alias("kind"), "file_id", "version", none("string", "hash"), "unchanged", none("long", "changed"), none("string", "justification")))


def _in_turn(spark, frames, name):
    """Frames written one after the other, as a stream that takes a file a batch."""
    base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for rows in frames:
        rows.coalesce(1).write.mode("append").parquet(f"{base}/in")
    return N.read_stream(spark, f"{base}/in", frames[0].schema, 1), base


@query("progress_changes", """WITH e AS (SELECT user_id AS file_id, CASE event_type WHEN 'purchase' THEN 'complete' ELSE event_type END AS stage, ts::TIMESTAMP AS moment FROM events),
l AS (SELECT file_id, max(moment) AS moment, arg_max(stage, (moment, stage)) AS stage FROM e GROUP BY 1), p AS (SELECT *, (SELECT max(moment) FROM e) - INTERVAL 10 MINUTE AS mark FROM l)
SELECT file_id, stage, moment AS "at", stage IN ('complete', 'error', 'failed') AS terminal FROM p UNION ALL SELECT file_id, 'timeout', moment, true FROM p WHERE stage NOT IN ('complete', 'error', 'failed') AND epoch_ms(moment) + 300000 < epoch_ms(mark)""")
def progress_changes(spark, sf):
    stream, base = _replayed(spark, _progress(spark, sf).coalesce(1), "progress")
    with W.rocksdb(spark):
        return _collected(W.progress_changes(stream), base).drop("progress")


@query("rate_limit_stream", with_tables("ledger", more=_OPENED) + """SELECT id, caller_service AS key, nth, nth <= 5 AS allowed, greatest(0, 5 - nth)::BIGINT AS remaining, ceil((epoch_us(start) + 3600000000 - epoch_us(created_at)) / 1000000)::BIGINT AS reset_in FROM n""")
def rate_limit_stream(spark, sf):
    """The ledger in four batches that follow one another."""
    rows = t.ledger(spark, sf).select("id", "caller_service", "created_at")
    edge = rows.select(F.expr("percentile(unix_micros(CAST(created_at AS timestamp)), array(0.25, 0.5, 0.75))")).first()[0]
    at = F.unix_micros(F.col("created_at").cast("timestamp"))
    frames = [rows.filter((at >= (edge[k - 1] if k else -(1 << 62))) & (at < (edge[k] if k < 3 else 1 << 62))) for k in range(4)]
    stream, base = _in_turn(spark, frames, "limited")
    with W.rocksdb(spark):
        return _collected(W.rate_limit_stream(stream, "caller_service", 5, 3600), base)


_STATES = with_tables("files", "docs", more="""f AS (SELECT file_id, CASE WHEN file_id % 3 = 0 THEN 'processed' ELSE status END AS status FROM files WHERE deleted_at IS NULL AND file_id % 11 <> 0),
d AS (SELECT coalesce(category, 'none') AS category FROM docs WHERE is_current)""")


@query("dashboard_changes", _STATES + """SELECT 'file_status' AS section, status AS item, count(*) AS n FROM f GROUP BY 2 UNION ALL SELECT 'category', category, count(*) FROM d GROUP BY 2
UNION ALL SELECT 'total', 'files', count(*) FROM f UNION ALL SELECT 'total', 'documents', count(*) FROM d UNION ALL SELECT 'total', 'pending', count(*) FROM f WHERE status = 'pending' UNION ALL SELECT 'total', 'active', count(*) FROM f WHERE status = 'processing'""")
def dashboard_changes(spark, sf):
    """All files and first versions; then every third file is processed, every eleventh deleted, and second versions take the place of first ones."""
    files = t.files(spark, sf).select("file_id", "status", "deleted_at", F.lit(1).alias("at"))
    docs = t.docs(spark, sf).select("doc_id", "category", F.lit(1).alias("at"), "is_current", "version")
    moved = files.filter("file_id % 3 = 0 OR file_id % 11 = 0").withColumn("status", F.lit("processed")).withColumn("deleted_at", F.when(F.col("file_id") % 11 == 0, F.lit("2024-07-01").cast("timestamp")).otherwise(F.col("deleted_at")))
    stamp = lambda df, k: df.withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000 + k)))
    first = docs.filter("version = 1").withColumn("is_current", F.lit(True)).drop("version")
    later = docs.filter("version = 2 OR NOT is_current").drop("version")
    f, base = _in_turn(spark, [stamp(files, 0), stamp(moved, 60)], "states")
    d, _ = _in_turn(spark, [stamp(first, 0), stamp(later, 60)], "states")
    W.dashboard_stream(f, d, f"{base}/lake", f"{base}/check").awaitTermination()
    return W.dashboard(spark, f"{base}/lake")
