"""Queries over search, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.stems import stem_sql
from millrace.operators import search as S
from millrace.plans import testbed as t
from millrace.plans.testbed import with_tables
from millrace.sources.shared import written

Q, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


_STOP = ", ".join(f"'{w}'" for w in S.STOP)
_POSTED = f"""words AS (SELECT doc_id, field, i - 1 AS position, w[i] AS term FROM (SELECT doc_id, field, w, unnest(range(1, len(w) + 1)) AS i FROM (
  SELECT doc_id, field, regexp_extract_all(lower(txt), '[\\p{{L}}\\p{{N}}]+') AS w FROM (SELECT doc_id, 'title' AS field, title AS txt FROM docs WHERE is_current UNION ALL SELECT doc_id, 'summary', summary FROM docs WHERE is_current UNION ALL SELECT doc_id, 'body', body FROM docs WHERE is_current)))),
vocab AS (SELECT DISTINCT term FROM words UNION SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) FROM benchmark),
stems AS MATERIALIZED ({stem_sql("vocab")}),
posts AS (SELECT stem AS term, doc_id, field, count(*) AS tf FROM words JOIN stems USING (term) WHERE term NOT IN ({_STOP}) GROUP BY 1, 2, 3),
weighed AS (SELECT *, tf * CASE field WHEN 'title' THEN 1.0::DOUBLE WHEN 'summary' THEN 0.4::DOUBLE ELSE 0.2::DOUBLE END AS s FROM posts)"""


def _postings(spark, sf, queries):
    """The index of all documents for the words that the queries ask for, as a lake holds it: built, written and read."""
    return written(S.build_postings(t.docs(spark, sf), asked=S.asked_terms(queries)), "postings")


def _keyword(spark, sf, k=20):
    """The keyword search's rows, written: what follows reads them more than once."""
    queries = _queries(spark, sf)
    return written(S.keyword_search(queries, _postings(spark, sf, queries), k), "hits")


def _queries(spark, sf):
    """A query for each benchmark item: its first words, in one of four forms."""
    w = F.split("text", r"\s+")
    form = F.expr("CASE item_id % 4 WHEN 0 THEN concat(w[0], ' ', w[4]) WHEN 1 THEN concat(w[0], ' OR ', w[5], ' ', w[3]) WHEN 2 THEN concat(w[0], ' -', w[6]) ELSE concat('\"', w[0], ' ', w[1], '\"') END")
    return t.read(spark, sf, "benchmark").withColumn("w", w).select(F.col("item_id").alias("query_id"), form.alias("text"))


@query("build_postings", with_tables("docs", more=_POSTED) + "SELECT term, doc_id, field, tf FROM posts")
def build_postings(spark, sf):
    return S.build_postings(t.docs(spark, sf)).drop("positions")


_ASKED = f"""q AS (SELECT item_id AS query_id, regexp_split_to_array(text, '\\s+') AS w FROM benchmark),
clean AS (SELECT query_id, [regexp_extract(lower(x), '[\\p{{L}}\\p{{N}}]+') FOR x IN w[1:7]] AS w FROM q),
must AS (SELECT * FROM (SELECT query_id, 0 AS clause, unnest(CASE query_id % 4 WHEN 0 THEN [w[1], w[5]] WHEN 1 THEN [w[1]] WHEN 2 THEN [w[1]] ELSE [w[1], w[2]] END) AS term FROM clean UNION SELECT query_id, 1, unnest([w[6], w[4]]) FROM clean WHERE query_id % 4 = 1) WHERE term NOT IN ({_STOP})),
wanted AS (SELECT DISTINCT query_id, clause, stem AS term FROM must JOIN stems USING (term)),
stemmed AS (SELECT doc_id, field, position, stem AS term FROM words JOIN stems USING (term) WHERE words.term NOT IN ({_STOP})),
need AS (SELECT query_id, clause, count(DISTINCT term) AS need FROM wanted GROUP BY 1, 2),
hit AS (SELECT query_id, clause, doc_id, count(DISTINCT term) AS have, sum(s) AS score FROM wanted JOIN weighed USING (term) GROUP BY 1, 2, 3),
near AS (SELECT DISTINCT query_id, x.doc_id FROM clean JOIN stems a ON a.term = w[1] JOIN stems b ON b.term = w[2] JOIN stemmed x ON x.term = a.stem JOIN stemmed y ON y.doc_id = x.doc_id AND y.field = x.field AND y.position = x.position + 1 AND y.term = b.stem WHERE query_id % 4 = 3),
half AS (SELECT DISTINCT query_id, x.doc_id FROM clean JOIN stems a ON a.term = CASE WHEN w[1] IN ({_STOP}) THEN w[2] ELSE w[1] END JOIN stemmed x ON x.term = a.stem WHERE query_id % 4 = 3 AND (w[1] IN ({_STOP}) OR w[2] IN ({_STOP}))),
gaps AS (SELECT query_id, clause, doc_id, min(CASE WHEN term <> before THEN position - place END) AS apart FROM (
  SELECT query_id, clause, doc_id, position, term, lag(term) OVER w AS before, lag(position) OVER w AS place FROM wanted JOIN stemmed USING (term) WINDOW w AS (PARTITION BY query_id, clause, doc_id, field ORDER BY position)) GROUP BY 1, 2, 3),
good AS (SELECT query_id, doc_id, round(max(score * (1 + coalesce(1.0::DOUBLE / apart, 0.0::DOUBLE))), 6) AS score FROM hit JOIN need USING (query_id, clause) LEFT JOIN gaps USING (query_id, clause, doc_id) WHERE have = need
  AND (query_id % 4 <> 3 OR (query_id, doc_id) IN (SELECT (query_id, doc_id) FROM near UNION ALL SELECT (query_id, doc_id) FROM half))
  AND NOT (query_id % 4 = 2 AND (query_id, doc_id) IN (SELECT (query_id, doc_id) FROM clean JOIN stems a ON a.term = w[7] JOIN posts ON posts.term = a.stem WHERE query_id % 4 = 2 AND w[7] NOT IN ({_STOP}))) GROUP BY 1, 2),
kw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM good) WHERE rank <= 60)"""


@query("keyword_search", with_tables("docs", more=_POSTED + ", " + _ASKED) + "SELECT query_id, doc_id, score, rank::INT AS rank FROM kw WHERE rank <= 20")
def keyword_search(spark, sf):
    queries = _queries(spark, sf)
    return S.keyword_search(queries, _postings(spark, sf, queries), 20)


@query("block_search", with_tables("docs", more=_POSTED + ", " + _ASKED) + "SELECT query_id, doc_id, score, rank::INT AS rank FROM kw WHERE rank <= 20")
def block_search(spark, sf):
    queries = _queries(spark, sf)
    blocked, tops = S.block_tops(_postings(spark, sf, queries))
    return S.block_search(queries, written(blocked, "blocked"), written(tops, "tops"), 20)


@query("highlight", r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents), b AS (SELECT doc_id, w, [regexp_replace(lower(x), '[^\p{L}\p{N}]', '', 'g') FOR x IN w] AS b FROM w),
h AS (SELECT doc_id, w, list_filter(range(1, len(b) + 1), lambda i: b[i] IN ('that', 'leaux')) AS h FROM b), f AS (SELECT doc_id, w, h, greatest(1, coalesce(h[1], 1) - 8) AS s FROM h),
g AS (SELECT doc_id, w, s, list_filter(h, lambda i: i >= s + 16)[1] AS hit FROM f), p AS (SELECT doc_id, w, s, CASE WHEN hit IS NOT NULL THEN greatest(s + 16, hit - 8) END AS z FROM g),
m AS (SELECT doc_id, s, z, [CASE WHEN regexp_replace(lower(x), '[^\p{L}\p{N}]', '', 'g') IN ('that', 'leaux') THEN '<mark>' || x || '</mark>' ELSE x END FOR x IN w] AS m FROM p)
SELECT doc_id, array_to_string(m[s : s + 15], ' ') || CASE WHEN z IS NULL THEN '' ELSE ' ... ' || array_to_string(m[z : z + 15], ' ') END AS snippet FROM m""")
def highlight(spark, sf):
    return t.read(spark, sf, "documents").select("doc_id", S.highlight(F.col("text"), F.array(F.lit("that"), F.lit("leaux")), 8).alias("snippet"))


def _semantic(spark, sf, k=20):
    vectors = t.read(spark, sf, "embeddings")
    return S.semantic_search(vectors.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), vectors.withColumnRenamed("vec_id", "doc_id"), k)


_SEM = "sem AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0)) WHERE rank <= 60)"


@query("semantic_search", f"WITH {_SEM} SELECT query_id, doc_id, round(score, 6) AS score, rank::INT AS rank FROM sem WHERE rank <= 20")
def semantic_search(spark, sf):
    return _semantic(spark, sf).withColumn("score", F.round("score", 6))


@query("hybrid_search", with_tables("docs", more=_POSTED + ", " + _ASKED + ", " + _SEM) + """, j AS (SELECT coalesce(k.query_id, s.query_id) AS query_id, coalesce(k.doc_id, s.doc_id) AS doc_id, k.rank AS rk, s.rank AS rs FROM kw k FULL JOIN sem s ON k.query_id = s.query_id AND k.doc_id = s.doc_id),
f AS (SELECT query_id, doc_id, round(coalesce(0.4::DOUBLE / (60 + rk), 0) + coalesce(0.6::DOUBLE / (60 + rs), 0), 6) AS score, rk, rs FROM j)
SELECT query_id, doc_id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rk NULLS LAST, rs NULLS LAST, doc_id) AS rank FROM f) WHERE rank <= 20""")
def hybrid_search(spark, sf):
    """Lists of 60 are fused, three times what is returned."""
    return S.hybrid_search(_keyword(spark, sf, 60), _semantic(spark, sf, 60))


@query("apply_filters", with_tables("entities") + "SELECT doc_id, category FROM entities WHERE category = 'research' AND created_at >= DATE '2024-01-03' AND created_at < DATE '2024-03-02' AND list_contains(names, 'That')")
def apply_filters(spark, sf):
    return S.apply_filters(t.entities(spark, sf), category="research", date_from="2024-01-03", date_to="2024-03-01", entities=["That"]).select("doc_id", "category")


@query("tag_filter", with_tables("docs") + "SELECT doc_id FROM docs WHERE source_file_id IN (SELECT doc_id FROM documents WHERE lang = 'fr' OR source = 'src3')")
def tag_filter(spark, sf):
    links = t.read(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), F.explode(F.array("lang", "source")).alias("name"))
    return S.apply_filters(t.docs(spark, sf), tags=["fr", "src3"], links=links).select("doc_id")


@query("recent_documents", with_tables("docs") + "SELECT doc_id, 0.0 AS score FROM docs WHERE is_current ORDER BY created_at DESC, doc_id DESC LIMIT 30")
def recent_documents(spark, sf):
    return S.recent_documents(t.docs(spark, sf), 30).select("doc_id", "score")


def _hard_queries(spark, sf):
    """Queries that the first search often cannot answer: five words of an item, with a word that is nowhere for some."""
    w = F.split("text", r"\s+")
    return t.read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.when(F.expr("item_id % 3 = 0"), F.concat_ws(" ", F.slice(w, 1, 5))).when(F.expr("item_id % 3 = 1"), F.concat(F.lit("zzqx "), F.concat_ws(" ", F.slice(w, 1, 3)))).otherwise(F.concat(F.substring("text", 3, 9), F.lit(""))).alias("text"))


_RUN = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"
_HARD = _POSTED.replace("FROM benchmark),", f"FROM benchmark UNION SELECT 'zzqx' UNION SELECT DISTINCT unnest({_RUN.format('substr(text, 3, 9)')}) FROM benchmark),") + f""",
hq AS (SELECT item_id AS query_id, CASE item_id % 3 WHEN 0 THEN array_to_string(w[1:5], ' ') WHEN 1 THEN 'zzqx ' || array_to_string(w[1:3], ' ') ELSE substr(text, 3, 9) END AS text FROM (SELECT *, regexp_split_to_array(text, '\\s+') AS w FROM benchmark)),
hw AS (SELECT DISTINCT query_id, stem AS term FROM (SELECT query_id, unnest({_RUN.format("text")}) AS term FROM hq) JOIN stems USING (term) WHERE term NOT IN ({_STOP})),
ho AS (SELECT DISTINCT query_id, stem AS term FROM (SELECT query_id, unnest(list_filter({_RUN.format("text")}, lambda x: length(x) > 2)[1:10]) AS term FROM hq) JOIN stems USING (term) WHERE term NOT IN ({_STOP})),
stemmed AS (SELECT doc_id, field, position, stem AS term FROM words JOIN stems USING (term) WHERE words.term NOT IN ({_STOP})),
gaps AS (SELECT query_id, doc_id, min(CASE WHEN term <> before THEN position - place END) AS apart FROM (
  SELECT query_id, doc_id, position, term, lag(term) OVER w AS before, lag(position) OVER w AS place FROM hw JOIN stemmed USING (term) WINDOW w AS (PARTITION BY query_id, doc_id, field ORDER BY position)) GROUP BY 1, 2),
s1 AS (SELECT query_id, doc_id, round(score * (1 + coalesce(1.0::DOUBLE / apart, 0.0::DOUBLE)), 6) AS score FROM (SELECT query_id, doc_id, count(DISTINCT term) AS have, sum(s) AS score FROM hw JOIN weighed USING (term) GROUP BY 1, 2)
  JOIN (SELECT query_id, count(*) AS need FROM hw GROUP BY 1) USING (query_id) LEFT JOIN gaps USING (query_id, doc_id) WHERE have = need),
s3 AS (SELECT query_id, doc_id, round(max(score), 6) AS score FROM (SELECT query_id, term, doc_id, sum(s) AS score FROM ho JOIN weighed USING (term) GROUP BY 1, 2, 3) WHERE query_id NOT IN (SELECT query_id FROM s1) GROUP BY 1, 2),
s4 AS (SELECT query_id, doc_id, created_at FROM hq JOIN docs ON is_current AND contains(lower(title || chr(10) || summary || chr(10) || body), lower(substr(hq.text, 1, 100))) WHERE query_id NOT IN (SELECT query_id FROM s1 UNION ALL SELECT query_id FROM s3))
SELECT query_id, doc_id, rank::INT AS rank, stage FROM (SELECT query_id, doc_id, 1 AS stage, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s1
  UNION ALL SELECT query_id, doc_id, 3, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) FROM s3
  UNION ALL SELECT query_id, doc_id, 4, row_number() OVER (PARTITION BY query_id ORDER BY created_at DESC, doc_id DESC) FROM s4) WHERE rank <= 10"""


@query("search_with_fallback", with_tables("docs", more=_HARD))
def search_with_fallback(spark, sf):
    docs, queries = t.docs(spark, sf), _hard_queries(spark, sf)
    return S.search_with_fallback(queries, docs, _postings(spark, sf, queries))


@query("retrieve_chunks", with_tables("docs", "chunks", more=_POSTED + ", " + _ASKED) + """SELECT query_id, doc_id, kw.rank::INT AS rank, chunk_index, content FROM kw JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) AS n FROM chunks) c USING (doc_id) WHERE kw.rank <= 8 AND n <= 5""")
def retrieve_chunks(spark, sf):
    return S.retrieve_chunks(_keyword(spark, sf), t.chunks(spark, sf))


@query("follow_up_chunks", with_tables("docs", "chunks", more=_POSTED + ", " + _ASKED) + """, found AS (SELECT DISTINCT query_id, doc_id FROM kw JOIN chunks USING (doc_id) WHERE kw.rank <= 2), more AS (SELECT query_id, 1 AS follow_up, doc_id, rank FROM kw UNION ALL SELECT query_id - 1, 2, doc_id, rank FROM kw WHERE query_id > 0),
o AS (SELECT query_id, doc_id, min(follow_up) AS follow_up FROM more WHERE rank <= 5 AND (query_id, doc_id) NOT IN (SELECT (query_id, doc_id) FROM found) GROUP BY 1, 2)
SELECT query_id, follow_up::INT AS follow_up, doc_id, chunk_index FROM o JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) AS n FROM chunks) c USING (doc_id) WHERE n <= 3""")
def follow_up_chunks(spark, sf):
    hits = _keyword(spark, sf)
    chunks = t.chunks(spark, sf)
    more = hits.withColumn("follow_up", F.lit(1)).unionByName(hits.filter("query_id > 0").withColumn("query_id", F.col("query_id") - 1).withColumn("follow_up", F.lit(2)))
    return S.follow_up_chunks(S.retrieve_chunks(hits, chunks, documents=2), more, chunks)


@query("related_questions", """WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT a.id AS query_id, b.id AS doc_id, list_cosine_similarity(a.v, b.v) AS s FROM e a, e b WHERE b.id < a.id)
SELECT query_id, doc_id, round(s, 3) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS rank FROM p WHERE s > 0.4::DOUBLE) WHERE rank <= 5""")
def related_questions(spark, sf):
    """Vectors stand in for question embeddings, their ids for time; the threshold suits them."""
    return S.related_questions(t.read(spark, sf, "embeddings").selectExpr("vec_id AS id", "embedding", "vec_id AS created_at"), 5, 0.4)
