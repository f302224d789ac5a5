"""Queries over the ledger, the question memory and citations, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import citations as E
from millrace.operators import ledger as K
from millrace.operators import memory as L
from millrace.plans import testbed as t
from millrace.plans.testbed import with_tables

Q, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def _shown(df, *sums):
    """Decimal sums as rounded doubles, so that both engines print them alike."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), 4) for c in sums})


_SUMS = "count(*) AS requests, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(total_tokens)::BIGINT AS total_tokens, round(sum(cost), 4) AS cost"


@query("usage_by", with_tables("ledger") + f"SELECT model AS key, {_SUMS}, round(avg(latency_ms), 1) AS avg_latency FROM ledger WHERE created_at >= TIMESTAMP '2024-01-05' AND created_at < TIMESTAMP '2024-01-25' AND status <> 'error' GROUP BY 1")
def usage_by(spark, sf):
    return _shown(K.usage_by(t.ledger(spark, sf), "model", "2024-01-05", "2024-01-25"), "cost")


@query("usage_report", with_tables("ledger") + f"SELECT purpose AS key, grouping(purpose)::INT AS is_total, {_SUMS}, round(avg(latency_ms), 2) AS avg_latency FROM ledger WHERE created_at >= TIMESTAMP '2024-01-10' GROUP BY ROLLUP (purpose)")
def usage_report(spark, sf):
    return _shown(K.usage_report(t.ledger(spark, sf), "purpose", "2024-01-10"), "cost")


@query("service_usage", with_tables("ledger") + f"SELECT {_SUMS} FROM ledger WHERE caller_service = 'purchase'")
def service_usage(spark, sf):
    return _shown(K.service_usage(t.ledger(spark, sf), "purchase"), "cost")


@query("daily_cost", with_tables("ledger") + "SELECT created_at::DATE::VARCHAR AS day, round(sum(cost), 4) AS cost FROM ledger GROUP BY 1")
def daily_cost(spark, sf):
    return _shown(K.daily_cost(t.ledger(spark, sf)), "cost").withColumn("day", F.col("day").cast("string"))


_HOURLY = f"SELECT date_trunc('hour', created_at) AS hour, caller_service, provider, model, {_SUMS}, sum(latency_ms)::BIGINT AS latency_sum, count(*) FILTER (status <> 'success') AS errors, count(fallback_from) AS fallbacks FROM ledger GROUP BY ALL"


@query("hourly_usage", with_tables("ledger") + _HOURLY)
def hourly_usage(spark, sf):
    return _shown(K.hourly_usage(t.ledger(spark, sf)), "cost")


_PRICES = [(1, "alpha", "alpha-large*", 0.003, 0.015), (2, "alpha", "*", 0.001, 0.002), (1, "gamma", "gamma-pro-?", 0.015, 0.075), (2, "gamma", "gamma*", 1.0, 1.0)]


@query("estimate_cost", with_tables("ledger") + """SELECT id, round(CASE WHEN provider = 'alpha' AND model LIKE 'alpha-large%' THEN input_tokens / 1000 * 0.003::DOUBLE + output_tokens / 1000 * 0.015::DOUBLE WHEN provider = 'alpha' THEN input_tokens / 1000 * 0.001::DOUBLE + output_tokens / 1000 * 0.002::DOUBLE
WHEN provider = 'gamma' AND model LIKE 'gamma-pro-_' THEN input_tokens / 1000 * 0.015::DOUBLE + output_tokens / 1000 * 0.075::DOUBLE WHEN provider = 'gamma' THEN input_tokens / 1000 + output_tokens / 1000 ELSE 0.0 END, 6) AS estimated FROM ledger""")
def estimate_cost(spark, sf):
    prices = spark.createDataFrame(_PRICES, "priority int, provider string, glob string, input_price double, output_price double")
    return K.estimate_cost(t.ledger(spark, sf), prices).select("id", F.round("estimated", 6).alias("estimated"))


@query("resolve_routes", with_tables("ledger") + """, r AS (SELECT id, purpose, CASE WHEN id % 3 = 0 THEN NULL WHEN id % 7 = 0 THEN 'delta-x' ELSE model END AS model, CASE WHEN id % 11 = 0 THEN 'named' END AS provider FROM ledger),
n AS (SELECT id, coalesce(model, CASE purpose WHEN 'summary' THEN 'beta-mini' WHEN 'answer' THEN 'alpha-large-2' END) AS model, provider FROM r)
SELECT id, model, coalesce(provider, CASE WHEN model LIKE 'alpha%' THEN 'alpha' WHEN model LIKE 'beta-%' THEN 'beta' WHEN model LIKE 'gamma-%' THEN 'gamma' END, CASE WHEN model IS NOT NULL THEN 'beta' END) AS provider,
CASE WHEN model IS NULL THEN 'unresolved' WHEN provider IS NOT NULL THEN 'explicit' WHEN model LIKE 'alpha%' OR model LIKE 'beta-%' OR model LIKE 'gamma-%' THEN 'route' ELSE 'fallback' END AS how FROM n""".replace(", r AS", "\n, r AS", 1))
def resolve_routes(spark, sf):
    asked = t.ledger(spark, sf).selectExpr("id", "purpose", "CASE WHEN id % 3 = 0 THEN NULL WHEN id % 7 = 0 THEN 'delta-x' ELSE model END AS model", "CASE WHEN id % 11 = 0 THEN 'named' END AS provider")
    purposes = spark.createDataFrame([("summary", "beta-mini"), ("answer", "alpha-large-2")], "purpose string, model string")
    routes = spark.createDataFrame([(1, "alpha*", "alpha"), (2, "beta-*", "beta"), (3, "gamma-*", "gamma"), (4, "alpha-l*", "other")], "priority int, glob string, provider string")
    return K.resolve_routes(asked, purposes, routes, ["beta", "alpha"])


@query("provider_health", with_tables("ledger", more=f"h AS ({_HOURLY})") + """, p AS (SELECT provider, hour, sum(requests) AS requests, sum(errors) AS errors, sum(fallbacks) AS fallbacks, sum(total_tokens) AS tokens FROM h GROUP BY 1, 2),
d AS (SELECT provider, hour::DATE AS day, sum(requests)::BIGINT AS requests, sum(errors)::BIGINT AS errors, max(fallbacks)::BIGINT AS worst_fallbacks, sum(tokens)::BIGINT AS tokens FROM p GROUP BY 1, 2)
SELECT provider, day::VARCHAR AS day, requests, errors, worst_fallbacks, tokens, round(errors / requests, 4) AS error_share, CASE WHEN errors / requests > 0.2 OR worst_fallbacks > 50 OR tokens > 9000 THEN 'critical' WHEN errors / requests > 0.05 OR worst_fallbacks > 10 OR tokens > 0.8::DOUBLE * 9000 THEN 'warning' ELSE 'ok' END AS level FROM d""")
def provider_health(spark, sf):
    return K.provider_health(K.hourly_usage(t.ledger(spark, sf)), 9000).withColumn("day", F.col("day").cast("string"))


@query("token_budget", with_tables("ledger") + """, s AS (SELECT caller_service, epoch(date_trunc('second', created_at))::BIGINT AS second, sum(total_tokens)::BIGINT AS tokens FROM ledger GROUP BY 1, 2)
SELECT *, last_day < 20000 AS under_limit FROM (SELECT *, (sum(tokens) OVER (PARTITION BY caller_service ORDER BY second RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW))::BIGINT AS last_hour, (sum(tokens) OVER (PARTITION BY caller_service ORDER BY second RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW))::BIGINT AS last_day FROM s)""")
def token_budget(spark, sf):
    return K.token_budget(t.ledger(spark, sf), "caller_service", 20000, tokens="total_tokens")


@query("run_until_budget", with_tables("memory") + """SELECT id, spent_before FROM (SELECT id, coalesce(sum(tokens_used) OVER (PARTITION BY theme ORDER BY created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS spent_before FROM memory) WHERE spent_before < 3000""")
def run_until_budget(spark, sf):
    return K.run_until_budget(t.memory(spark, sf), "theme", ["created_at", "id"], 3000).select("id", "spent_before")


@query("rate_limit_aligned", with_tables("ledger") + """SELECT id, caller_service, w AS window_start, n::INT AS nth, n <= 5 AS allowed, greatest(0, 5 - n)::INT AS remaining FROM (SELECT id, caller_service, time_bucket(INTERVAL 1 HOUR, created_at) AS w, row_number() OVER (PARTITION BY caller_service, time_bucket(INTERVAL 1 HOUR, created_at) ORDER BY created_at, id) AS n FROM ledger)""")
def rate_limit_aligned(spark, sf):
    return K.rate_limit_aligned(t.ledger(spark, sf), "caller_service", 5, "1 hour")


_OPENED = """o AS (SELECT caller_service, min(created_at) AS start FROM ledger GROUP BY 1
  UNION SELECT o.caller_service, min(l.created_at) FROM o JOIN ledger l ON l.caller_service = o.caller_service AND l.created_at >= o.start + INTERVAL 1 HOUR GROUP BY o.caller_service, o.start),
n AS (SELECT l.id, l.caller_service, l.created_at, o.start, row_number() OVER (PARTITION BY l.caller_service, o.start ORDER BY l.created_at, l.id) AS nth FROM ledger l ASOF JOIN o ON l.caller_service = o.caller_service AND l.created_at >= o.start)"""


@query("rate_limit", with_tables("ledger", more=_OPENED) + """SELECT id, caller_service AS key, nth, nth <= 5 AS allowed, greatest(0, 5 - nth)::BIGINT AS remaining, ceil((epoch_us(start) + 3600000000 - epoch_us(created_at)) / 1000000)::BIGINT AS reset_in FROM n""")
def rate_limit(spark, sf):
    return K.rate_limit(t.ledger(spark, sf), "caller_service", 5, 3600)


# question memory


@query("theme_summary", with_tables("memory") + "SELECT theme, count(*) AS n, round(avg(confidence), 2) AS avg_confidence, max(created_at) AS last_asked FROM memory WHERE theme IS NOT NULL GROUP BY theme")
def theme_summary(spark, sf):
    return L.theme_summary(t.memory(spark, sf))


@query("memory_stats", with_tables("memory") + "SELECT count(*) AS total, count(DISTINCT theme) AS themes, round(avg(confidence), 4) AS avg_confidence, sum(tokens_used)::BIGINT AS tokens, count(*) FILTER (led_to_analysis) AS analyses FROM memory")
def memory_stats(spark, sf):
    return L.memory_stats(t.memory(spark, sf))


@query("curiosity", with_tables("memory") + """, n AS (SELECT * FROM memory WHERE len(follow_ups) > 0 ORDER BY created_at DESC, id DESC LIMIT 20), x AS (SELECT created_at, id, i AS place, follow_ups[i + 1] AS question FROM (SELECT *, unnest(range(0, len(follow_ups))) AS i FROM n)),
f AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY created_at DESC, id DESC, place) AS k FROM x) SELECT question, id, place::INT AS place FROM f WHERE k = 1 ORDER BY created_at DESC, id DESC, place LIMIT 20""")
def curiosity(spark, sf):
    return L.curiosity(t.memory(spark, sf))


@query("unexplored", with_tables("memory") + """, x AS (SELECT created_at, id, i AS place, follow_ups[i + 1] AS question FROM (SELECT *, unnest(range(0, len(follow_ups))) AS i FROM memory WHERE follow_ups IS NOT NULL))
SELECT question, id, place::INT AS place FROM x WHERE lower(question) NOT IN (SELECT lower(question) FROM memory) ORDER BY created_at DESC, id DESC, place LIMIT 100""")
def unexplored(spark, sf):
    return L.unexplored(t.memory(spark, sf), 100)


@query("list_memory", with_tables("memory") + "SELECT id, question, substr(answer, 1, 500) AS answer, theme, created_at FROM memory WHERE theme = 'theme-2' ORDER BY created_at DESC, id DESC LIMIT 50")
def list_memory(spark, sf):
    return L.list_memory(t.memory(spark, sf), 50, "theme-2")


# citations

_CITED = "cited AS (SELECT doc_id, chunk_index + 1 AS citation_index, chunk_index, source_locator, substr(content, 1, 150) AS quote FROM chunks)"


@query("generate_citations", with_tables("chunks", more=_CITED) + "SELECT * FROM cited")
def generate_citations(spark, sf):
    return E.generate_citations(t.chunks(spark, sf))


@query("document_citations", with_tables("chunks", "docs", more=_CITED) + "SELECT doc_id, citation_index, quote, '/api/v1/vault/files/' || source_file_id || '/download#chunk=' || citation_index AS url FROM cited JOIN docs USING (doc_id)")
def document_citations(spark, sf):
    return E.document_citations(t.docs(spark, sf), E.generate_citations(t.chunks(spark, sf)))


@query("citation_url", with_tables("chunks") + "SELECT doc_id, chunk_index, '/api/v1/vault/files/' || doc_id || '/download#chunk=' || (chunk_index + 1) AS url FROM chunks")
def citation_url(spark, sf):
    return t.chunks(spark, sf).select("doc_id", "chunk_index", E.citation_url(F.col("doc_id"), F.col("chunk_index") + 1).alias("url"))


@query("assemble_markdown", with_tables("chunks", "docs", more=_CITED) + """, l AS (SELECT doc_id, string_agg('[' || citation_index || '] ' || source_locator, chr(10) ORDER BY citation_index) AS lines FROM cited GROUP BY doc_id)
SELECT doc_id, '# ' || title || chr(10) || chr(10) || summary || CASE WHEN lines IS NOT NULL THEN chr(10) || chr(10) || '## Citations' || chr(10) || chr(10) || lines ELSE '' END AS body_markdown FROM docs LEFT JOIN l USING (doc_id)""")
def assemble_markdown(spark, sf):
    return E.assemble_markdown(t.docs(spark, sf), E.generate_citations(t.chunks(spark, sf)))


@query("assemble_full_markdown", with_tables("chunks", "docs", more=_CITED) + r""", l AS (SELECT doc_id, string_agg('[' || citation_index || '] ' || source_locator, chr(10) ORDER BY citation_index) AS lines FROM cited GROUP BY doc_id),
q AS (SELECT doc_id, array_to_string(list_transform(string_split(body, chr(10))[1:10], lambda x: '> ' || x), chr(10) || chr(10)) AS said FROM docs)
SELECT doc_id, sha256(concat_ws(chr(10) || chr(10), '# ' || title, summary, '## About ' || category || chr(10) || chr(10) || title || chr(10) || '- ' || category || chr(10) || '- v' || version || chr(10) || chr(10) || '## More' || chr(10) || chr(10) || category,
  '## People' || chr(10) || chr(10) || '- ' || category || ' lead (owner)' || chr(10) || '- someone', '## Key quotes' || chr(10) || chr(10) || said, '## Citations' || chr(10) || chr(10) || lines)) AS hash FROM docs LEFT JOIN l USING (doc_id) JOIN q USING (doc_id)""")
def assemble_full_markdown(spark, sf):
    """The long layout: two sections, two people, the first ten lines as quotes, and the citations."""
    docs = t.docs(spark, sf).withColumns({
        "sections": F.expr("array(named_struct('heading', concat('About ', category), 'summary', title, 'key_points', array(category, concat('v', version))), named_struct('heading', 'More', 'summary', category, 'key_points', CAST(array() AS array<string>)))"),
        "people": F.expr("array(named_struct('name', concat(category, ' lead'), 'role', 'owner'), named_struct('name', 'someone', 'role', CAST(NULL AS string)))"), "key_quotes": F.split("body", "\n")})
    return E.assemble_full_markdown(docs, E.generate_citations(t.chunks(spark, sf))).select("doc_id", F.sha2("body_markdown", 256).alias("hash"))


@query("extract_source_refs", with_tables("chunks") + """, a AS (SELECT doc_id AS id FROM documents), s AS (SELECT doc_id AS id, chunk_index AS n, doc_id, chunk_index, content FROM chunks),
x AS (SELECT id, 2 AS n, 0 AS seen FROM a UNION SELECT id, id % 4, 1 FROM a WHERE id % 4 <> 2)
SELECT id, n::INT AS n, row_number() OVER (PARTITION BY id ORDER BY seen)::INT AS place, doc_id, chunk_index, substr(content, 1, 200) AS quote, '/api/v1/vault/files/' || doc_id || '/download#chunk=' || chunk_index AS url FROM x JOIN s USING (id, n)""")
def extract_source_refs(spark, sf):
    answers = t.read(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("See [Source 2], [Source "), F.col("doc_id") % 4, F.lit("] and [Source 2].")).alias("answer"))
    sources = t.chunks(spark, sf).select(F.col("doc_id").alias("id"), F.col("chunk_index").alias("n"), "doc_id", "chunk_index", "content")
    return E.extract_source_refs(answers, sources)


@query("verify_citations", with_tables("chunks", more=_CITED) + "SELECT * FROM cited WHERE doc_id % 10 = 0 AND chunk_index % 2 = 0")
def verify_citations(spark, sf):
    chunks = t.chunks(spark, sf)
    return E.verify_citations(E.generate_citations(chunks), chunks.filter("NOT (doc_id % 10 = 0 AND chunk_index % 2 = 0)"))
