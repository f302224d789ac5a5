"""The lake's tables, derived by Spark from the given tables, with the same derivations as DuckDB SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import hard_split

CHUNK_TOKENS = 64
_EXT = "CASE {id} % 4 WHEN 0 THEN '.txt' WHEN 1 THEN '.md' WHEN 2 THEN '.csv' ELSE '.json' END"
_TYPE = "CASE {id} % 4 WHEN 0 THEN 'text/plain' WHEN 1 THEN 'text/markdown' WHEN 2 THEN 'text/csv' ELSE 'application/json' END"
_STATUS = "CASE {id} % 5 WHEN 0 THEN 'processed' WHEN 1 THEN 'pending' WHEN 2 THEN 'failed' WHEN 3 THEN 'processing' ELSE 'processed' END"
_CATEGORY = "CASE doc_id % 6 WHEN 0 THEN 'technical' WHEN 1 THEN 'business' WHEN 2 THEN 'operational' WHEN 3 THEN 'research' WHEN 4 THEN 'communication' ELSE 'reference' END"
_PROVIDER = "CASE user_id % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'gamma' END"
_MODEL = "CASE user_id % 3 WHEN 0 THEN 'alpha-large-2' WHEN 1 THEN 'beta-mini' ELSE 'gamma-pro-1' END"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").selectExpr(
        "doc_id AS file_id", f"concat(lower(source), '-', doc_id, {_EXT.format(id='doc_id')}) AS filename", f"{_TYPE.format(id='doc_id')} AS content_type",
        "CAST(char_length(text) AS bigint) AS size_bytes", "sha2(text, 256) AS sha256", f"{_STATUS.format(id='doc_id')} AS status", "source AS folder",
        "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, doc_id) AS created_at",
        "CASE WHEN doc_id % 17 = 0 THEN timestamp'2024-06-01 00:00:00' END AS deleted_at",
    )


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versioned documents: a second version for every tenth."""
    one = read(spark, sf_dir, "documents").selectExpr(
        "doc_id", "doc_id AS source_file_id", "substring(split(text, '\n')[0], 1, 60) AS title", "substring(text, 1, 500) AS summary", f"{_CATEGORY} AS category", "text AS body",
        "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, doc_id * 60) AS created_at", "1 AS version", "doc_id % 10 <> 0 AS is_current",
    )
    two = one.filter("doc_id % 10 = 0").selectExpr("doc_id + 1000000 AS doc_id", "source_file_id", "title", "summary", "category", "concat(body, ' Revised.') AS body", "created_at + interval 30 days AS created_at", "2 AS version", "true AS is_current")
    return one.unionByName(two)


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the arrays that an analysis gives: entities and relationships of capitalised words."""
    names = "regexp_extract_all(body, '[A-Z][a-z]{3,}', 0)"
    base = docs(spark, sf_dir).selectExpr("doc_id", "title", "category", "created_at", "is_current", f"{names} AS names")
    return base.selectExpr(
        "doc_id", "title", "category", "created_at", "is_current", "names",
        "transform(names, n -> named_struct('name', n, 'type', CASE length(n) % 3 WHEN 0 THEN 'person' WHEN 1 THEN 'organization' ELSE 'concept' END, 'context', substring(n, 1, 1), 'mentions', length(n))) AS entities",
        # neighbours are put side by side first: an expression that looks into the list for each of them may be computed again for each, once Spark has moved it into a filter
        "transform(IF(size(names) > 1, zip_with(slice(names, 1, size(names) - 1), slice(names, 2, size(names) - 1), (a, b) -> named_struct('a', a, 'b', b)), CAST(array() AS array<struct<a: string, b: string>>)), (p, i) -> named_struct('source', p.a, 'target', p.b, 'type', CASE (i + 1) % 2 WHEN 0 THEN 'works with' ELSE 'part-of' END, 'confidence', CAST((i + 1) % 10 AS double) / 10, 'description', concat('r', i + 1))) AS relationships",
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunked(read(spark, sf_dir, "documents").select("doc_id", F.col("text")))


def chunks2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of a later upload: in every tenth document a word has changed and a sentence was added."""
    changed = F.when(F.col("doc_id") % 10 == 0, F.concat(F.replace("text", F.lit(" the "), F.lit(" that ")), F.lit(" An added sentence stands here."))).otherwise(F.col("text"))
    return chunked(read(spark, sf_dir, "documents").select("doc_id", changed.alias("text")))


def chunked(texts: DataFrame) -> DataFrame:
    rows = texts.select("doc_id", F.posexplode(hard_split(F.col("text"), CHUNK_TOKENS)).alias("chunk_index", "content"))
    return rows.select("doc_id", "chunk_index", "content", F.size(F.split("content", " ")).alias("token_count"), F.sha2("content", 256).alias("content_hash"), F.concat(F.lit("chunk:"), F.col("chunk_index")).alias("source_locator"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").selectExpr(
        "event_id AS id", "event_type AS caller_service", "CASE user_id % 4 WHEN 0 THEN 'summary' WHEN 1 THEN 'analysis' WHEN 2 THEN 'answer' END AS purpose", f"{_PROVIDER} AS provider", f"{_MODEL} AS model",
        "CAST(get_json_object(props, '$.k') AS bigint) AS input_tokens", "CAST(floor(value) AS bigint) AS output_tokens", "CAST(floor(value * 10) AS bigint) AS latency_ms",
        "CASE WHEN event_type = 'error' THEN 'error' WHEN event_id % 13 = 0 THEN 'fallback' ELSE 'success' END AS status", "CASE WHEN event_id % 13 = 0 THEN 'alpha' END AS fallback_from", "ts AS created_at",
        "CAST(CAST(get_json_object(props, '$.k') AS bigint) * 3 + CAST(floor(value) AS bigint) * 15 AS decimal(18,6)) / 1000 AS cost",
    ).withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens")).withColumn("cost", F.col("cost").cast("decimal(18,6)"))


def memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as questions with the next turn of the assistant."""
    turns = read(spark, sf_dir, "conversations")
    asked = turns.filter("role = 'user'").alias("q").join(turns.filter("role = 'assistant'").alias("a"), F.expr("q.conv_id = a.conv_id AND a.turn = q.turn + 1"), "left")
    return asked.selectExpr(
        "q.conv_id * 1000 + q.turn AS id", "q.text AS question", "a.text AS answer", "CASE WHEN q.conv_id % 7 < 6 THEN concat('theme-', q.conv_id % 7) END AS theme", "CAST(q.conv_id % 10 AS double) / 10 AS confidence",
        "CAST(size(split(q.text, ' ')) + coalesce(size(split(a.text, ' ')), 0) AS bigint) AS tokens_used", "q.conv_id % 3 = 0 AS led_to_analysis",
        "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, q.conv_id * 10 + q.turn) AS created_at", "split(a.text, '\n') AS follow_ups",
    )


def folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region, nation and customer as a tree; ids are prefixed by level."""
    r, n, c = (read(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    level1 = r.selectExpr("concat('r', r_regionkey) AS id", "r_name AS name", "CAST(NULL AS string) AS parent_id")
    level2 = n.selectExpr("concat('n', n_nationkey) AS id", "n_name AS name", "concat('r', n_regionkey) AS parent_id")
    level3 = c.selectExpr("concat('c', c_custkey) AS id", "c_name AS name", "concat('n', c_nationkey) AS parent_id")
    return level1.unionByName(level2).unionByName(level3)


def folder_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS file_id", "concat('order-', o_orderkey) AS filename", "concat('c', o_custkey) AS folder_id", f"{_STATUS.format(id='o_orderkey')} AS status",
        "CASE WHEN o_orderkey % 17 = 0 THEN timestamp'2024-06-01 00:00:00' END AS deleted_at", "CAST(o_orderdate AS timestamp) AS created_at",
    )


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who and what each order names, in several spellings."""
    line, sup, part = (read(spark, sf_dir, t) for t in ("lineitem", "supplier", "part"))
    who = line.join(sup, F.col("l_suppkey") == F.col("s_suppkey")).selectExpr(
        "l_orderkey AS doc_id", "l_linenumber * 2 AS position", "CASE l_linenumber % 3 WHEN 0 THEN concat('The ', s_name) WHEN 1 THEN concat(s_name, ', Inc.') ELSE s_name END AS name", "'organization' AS type", "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, l_orderkey) AS created_at")
    what = line.join(part, F.col("l_partkey") == F.col("p_partkey")).selectExpr("l_orderkey AS doc_id", "l_linenumber * 2 + 1 AS position", "p_brand AS name", "'product' AS type", "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, l_orderkey) AS created_at")
    return who.unionByName(what)


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, sup, part = (read(spark, sf_dir, t) for t in ("lineitem", "supplier", "part"))
    # suppliers last: their lines then lie together, and are counted where they lie
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).join(sup, F.col("l_suppkey") == F.col("s_suppkey")).selectExpr(
        "l_orderkey AS doc_id", "l_linenumber AS position", "CASE l_linenumber % 3 WHEN 0 THEN concat('The ', s_name) ELSE s_name END AS source", "CASE WHEN l_linenumber % 5 = 4 THEN 'Nobody Ltd' ELSE p_brand END AS target",
        "CASE l_returnflag WHEN 'R' THEN 'took back' WHEN 'A' THEN 'sells' ELSE 'ships-to' END AS type", "CAST(1 - l_discount AS double) AS confidence", "concat('line ', l_linenumber) AS description",
        "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, l_orderkey) AS created_at",
    )


#: The same tables for DuckDB.
SQL = {
    "files": f"""SELECT doc_id AS file_id, lower(source) || '-' || doc_id || {_EXT.format(id="doc_id")} AS filename, {_TYPE.format(id="doc_id")} AS content_type,
        length(text)::BIGINT AS size_bytes, sha256(text) AS sha256, {_STATUS.format(id="doc_id")} AS status, source AS folder,
        TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS created_at, CASE WHEN doc_id % 17 = 0 THEN TIMESTAMP '2024-06-01 00:00:00' END AS deleted_at FROM documents""",
    "docs1": f"""SELECT doc_id, doc_id AS source_file_id, substr(string_split(text, chr(10))[1], 1, 60) AS title, substr(text, 1, 500) AS summary, {_CATEGORY} AS category, text AS body,
        TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id * 60) AS created_at, 1 AS version, doc_id % 10 <> 0 AS is_current FROM documents""",
    "docs": """SELECT * FROM docs1 UNION ALL SELECT doc_id + 1000000, source_file_id, title, summary, category, body || ' Revised.', created_at + INTERVAL 30 DAY, 2, true FROM docs1 WHERE doc_id % 10 = 0""",
    "entities": """SELECT doc_id, title, category, created_at, is_current, regexp_extract_all(body, '[A-Z][a-z]{3,}') AS names FROM docs""",
    "ents": """SELECT doc_id, title, category, created_at, is_current, i AS position, names[i] AS name, CASE length(names[i]) % 3 WHEN 0 THEN 'person' WHEN 1 THEN 'organization' ELSE 'concept' END AS type,
        substr(names[i], 1, 1) AS context, length(names[i]) AS mentions FROM (SELECT *, unnest(range(1, len(names) + 1)) AS i FROM entities)""",
    "rels": """SELECT doc_id, title, created_at, is_current, i AS position, names[i] AS source, names[i + 1] AS target, CASE i % 2 WHEN 0 THEN 'works with' ELSE 'part-of' END AS type, (i % 10)::DOUBLE / 10 AS confidence, 'r' || i AS description
        FROM (SELECT *, unnest(range(1, len(names))) AS i FROM entities)""",
    "chunks": f"""SELECT doc_id, i::INT AS chunk_index, array_to_string(w[i * {CHUNK_TOKENS} + 1 : (i + 1) * {CHUNK_TOKENS}], ' ') AS content, len(w[i * {CHUNK_TOKENS} + 1 : (i + 1) * {CHUNK_TOKENS}])::INT AS token_count,
        sha256(array_to_string(w[i * {CHUNK_TOKENS} + 1 : (i + 1) * {CHUNK_TOKENS}], ' ')) AS content_hash, 'chunk:' || i AS source_locator
        FROM (SELECT doc_id, w, unnest(range(0, (len(w) + {CHUNK_TOKENS} - 1) // {CHUNK_TOKENS})) AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents))""",
    "ledger": f"""SELECT event_id AS id, event_type AS caller_service, CASE user_id % 4 WHEN 0 THEN 'summary' WHEN 1 THEN 'analysis' WHEN 2 THEN 'answer' END AS purpose, {_PROVIDER} AS provider, {_MODEL} AS model,
        json_extract_string(props, '$.k')::BIGINT AS input_tokens, floor(value)::BIGINT AS output_tokens, floor(value * 10)::BIGINT AS latency_ms,
        CASE WHEN event_type = 'error' THEN 'error' WHEN event_id % 13 = 0 THEN 'fallback' ELSE 'success' END AS status, CASE WHEN event_id % 13 = 0 THEN 'alpha' END AS fallback_from, ts AS created_at,
        (json_extract_string(props, '$.k')::BIGINT * 3 + floor(value)::BIGINT * 15)::DOUBLE / 1000 AS cost, json_extract_string(props, '$.k')::BIGINT + floor(value)::BIGINT AS total_tokens FROM events""",
    "memory": """SELECT q.conv_id * 1000 + q.turn AS id, q.text AS question, a.text AS answer, CASE WHEN q.conv_id % 7 < 6 THEN 'theme-' || (q.conv_id % 7) END AS theme, (q.conv_id % 10)::DOUBLE / 10 AS confidence,
        (len(string_split(q.text, ' ')) + coalesce(len(string_split(a.text, ' ')), 0))::BIGINT AS tokens_used, q.conv_id % 3 = 0 AS led_to_analysis,
        TIMESTAMP '2024-01-01 00:00:00' + to_minutes(q.conv_id * 10 + q.turn) AS created_at, string_split(a.text, chr(10)) AS follow_ups
        FROM conversations q LEFT JOIN conversations a ON q.conv_id = a.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant' WHERE q.role = 'user'""",
    "folders": """SELECT 'r' || r_regionkey AS id, r_name AS name, NULL::VARCHAR AS parent_id FROM region UNION ALL SELECT 'n' || n_nationkey, n_name, 'r' || n_regionkey FROM nation UNION ALL SELECT 'c' || c_custkey, c_name, 'n' || c_nationkey FROM customer""",
    "paths": """SELECT f.id, f.name, f.parent_id, CASE WHEN g.id IS NULL THEN '/' || f.name WHEN p.id IS NULL THEN '/' || g.name || '/' || f.name ELSE '/' || p.name || '/' || g.name || '/' || f.name END AS path
        FROM folders f LEFT JOIN folders g ON f.parent_id = g.id LEFT JOIN folders p ON g.parent_id = p.id""",
    "folder_files": f"""SELECT o_orderkey AS file_id, 'order-' || o_orderkey AS filename, 'c' || o_custkey AS folder_id, {_STATUS.format(id="o_orderkey")} AS status,
        CASE WHEN o_orderkey % 17 = 0 THEN TIMESTAMP '2024-06-01 00:00:00' END AS deleted_at, o_orderdate::TIMESTAMP AS created_at FROM orders""",
    "mentions": """SELECT l_orderkey AS doc_id, l_linenumber * 2 AS position, CASE l_linenumber % 3 WHEN 0 THEN 'The ' || s_name WHEN 1 THEN s_name || ', Inc.' ELSE s_name END AS name, 'organization' AS type, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(l_orderkey) AS created_at FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
        UNION ALL SELECT l_orderkey, l_linenumber * 2 + 1, p_brand, 'product', TIMESTAMP '2024-01-01 00:00:00' + to_minutes(l_orderkey) FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "relations": """SELECT l_orderkey AS doc_id, l_linenumber AS position, CASE l_linenumber % 3 WHEN 0 THEN 'The ' || s_name ELSE s_name END AS source, CASE WHEN l_linenumber % 5 = 4 THEN 'Nobody Ltd' ELSE p_brand END AS target,
        CASE l_returnflag WHEN 'R' THEN 'took back' WHEN 'A' THEN 'sells' ELSE 'ships-to' END AS type, (1 - l_discount)::DOUBLE AS confidence, 'line ' || l_linenumber AS description,
        TIMESTAMP '2024-01-01 00:00:00' + to_minutes(l_orderkey) AS created_at FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey""",
    "canon_mentions": """SELECT *, {canon:name} AS canonical FROM mentions""",
    "vertices": """SELECT canonical, arg_min(name, k) AS name, arg_min(type, k) AS entity_type, min(created_at) AS first_seen, count(*) AS mention_count, count(DISTINCT doc_id) AS document_count
        FROM (SELECT *, (created_at, doc_id, position) AS k FROM canon_mentions WHERE canonical <> '') GROUP BY canonical""",
    "canon_relations": """SELECT *, {canon:source} AS src, {canon:target} AS dst, upper(regexp_replace(type, '[^A-Za-z0-9_]', '_', 'g')) AS rel FROM relations""",
    "edges": """SELECT src, dst, rel, count(*) AS weight, arg_min(description, k) AS description, arg_min(confidence, k) AS confidence, arg_min(doc_id, k) AS source_document_id
        FROM (SELECT *, (created_at, doc_id, position) AS k FROM canon_relations) WHERE src IN (SELECT canonical FROM vertices) AND dst IN (SELECT canonical FROM vertices) GROUP BY src, dst, rel""",
}
_NEEDS = {"docs": ["docs1"], "entities": ["docs1", "docs"], "ents": ["docs1", "docs", "entities"], "rels": ["docs1", "docs", "entities"], "paths": ["folders"], "canon_mentions": ["mentions"], "vertices": ["mentions", "canon_mentions"], "canon_relations": ["relations"], "edges": ["mentions", "canon_mentions", "vertices", "relations", "canon_relations"]}
SQL["chunks2"] = SQL["chunks"].replace("regexp_split_to_array(text", "regexp_split_to_array(CASE WHEN doc_id % 10 = 0 THEN replace(text, ' the ', ' that ') || ' An added sentence stands here.' ELSE text END")


def canonical_sql(column: str) -> str:
    """An entity's key in DuckDB, from the rule: trim; a leading The; one ending, as a word, with what stands around it; closing
    punctuation; runs of white space; lower case."""
    column = f"regexp_replace(trim({column}, ' \t\n\r'), '^[Tt][Hh][Ee]\\s+', '')"
    column = f"regexp_replace({column}, '\\s*,?\\s*\\b(inc|corp|corporation|llc|ltd|limited|gmbh|co|company|plc|lp|llp|ag|sa|nv|bv)\\b\\.?\\s*$', '', 'i')"
    return f"lower(trim(regexp_replace(rtrim({column}, '.,;:!?'), '\\s+', ' ', 'g')))"


def with_tables(*names: str, more: str = "") -> str:
    """A WITH clause that defines the named tables and what they need, and further definitions after them."""
    order: list[str] = []
    for n in names:
        order += [x for x in [*_NEEDS.get(n, []), n] if x not in order]
    parts = []
    for n in order:
        sql = SQL[n]
        for column in ("name", "source", "target"):
            sql = sql.replace("{canon:" + column + "}", canonical_sql(column))
        parts.append(f"{n} AS ({sql})")
    return "WITH RECURSIVE " + ",\n".join(parts + ([more] if more else [])) + "\n"
