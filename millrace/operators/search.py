"""Search for tables of queries: keywords, vectors, fused ranks, filters, retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.stems import stem
from millrace.functions.text import let
from millrace.operators.grams import containing
from millrace.operators.nearest import nearest
from millrace.sources.shared import written

#: Words that are not indexed.
STOP = tuple("""
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves
what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while
of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here
there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now
""".split())
#: Weights of fields.
WEIGHTS = {"title": 1.0, "summary": 0.4, "body": 0.2}
#: Queries whose vectors are held by each task at a time.
QUERY_BLOCK = 4096


def terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def build_postings(documents: DataFrame, body_chars: int | None = None, asked: DataFrame | None = None) -> DataFrame:
    """term, doc_id, field, tf and positions of current documents: English stems, without stop words; of whole bodies, or of their
    first body_chars characters. asked (term: stems, see asked_terms) limits the index to what a table of queries needs.

    A document's words are sorted and gathered inside its row, so only whole texts are dealt out, by doc_id, and nothing is shuffled by word. Stems are made for
    the distinct words, which a first pass over the texts finds, and joined to the gathered ones; while Spark finds their table small enough to broadcast,
    the rows of a document stay together until they are grouped by stem.

    With asked, all texts are read as well, but each different word that begins like an asked stem is stemmed once, and only places of words with an asked stem leave the scan:
    neither texts nor other words are shuffled or written, so the index grows with what the queries hit.
    """
    text = lambda k: F.col(k) if k != "body" or body_chars is None else F.substring(k, 1, body_chars)
    texts = documents.filter("is_current").select("doc_id", *(text(k).alias(k) for k in WEIGHTS))
    words = texts.select(F.explode(F.array(*WEIGHTS)).alias("text")).select(F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).filter(~F.col("term").isin(*STOP))
    fields = F.array(*(F.struct(F.lit(k).alias("field"), F.col(k).alias("text")) for k in WEIGHTS))
    if asked is not None:
        asked = asked.select(F.col("term").alias("stem")).distinct()
        near = words.join(asked.select(_beginnings(F.col("stem")).alias("b")).distinct(), F.substring("term", 1, 2) == F.col("b"), "left_semi").distinct()
        near = written(near, "near-words")  # else Spark moves the join below ahead of distinct and stems each word of each text
        stems = written(near.withColumn("stem", stem(F.col("term"))).join(asked, "stem", "left_semi"), "stems")
        placed = texts.select("doc_id", F.explode(fields).alias("f")).select("doc_id", "f.field", F.posexplode(terms(F.col("f.text"))).alias("position", "term"))
        found = placed.join(stems, "term").groupBy(F.col("stem").alias("term"), "doc_id", "field").agg(F.sort_array(F.collect_list("position")).alias("positions"))
        return found.select("term", "doc_id", "field", F.size("positions").cast("long").alias("tf"), "positions")
    stems = written(words.distinct().withColumn("stem", stem(F.col("term"))), "stems")
    each = texts.repartition("doc_id").select("doc_id", F.explode(fields).alias("f")).select("doc_id", "f.field", F.inline(_gathered(terms(F.col("f.text"))))).filter(~F.col("term").isin(*STOP))
    found = each.join(stems, "term").groupBy(F.col("stem").alias("term"), "doc_id", "field").agg(F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))
    return found.select("term", "doc_id", "field", F.size("positions").cast("long").alias("tf"), "positions")


def _beginnings(stems: Column) -> Column:
    """How the words of a stem can begin: with its first two letters; a stem of one letter comes from that letter alone or with -ed, -ing and their adverbs."""
    some = F.when(F.char_length(stems) == 1, F.array(stems, F.concat(stems, F.lit("e")), F.concat(stems, F.lit("i"))))
    return F.explode(some.otherwise(F.array(F.substring(stems, 1, 2))))


def asked_terms(queries: DataFrame) -> DataFrame:
    """The stems (term) of all words of web-style queries (text), whatever their kind: what an index must have to answer them."""
    words = queries.select(F.explode(terms(F.col("text"))).alias("term")).filter(~F.col("term").isin(*STOP)).distinct()
    return written(words.select(stem(F.col("term")).alias("term")).distinct(), "asked")


def _gathered(words: Column) -> Column:
    """An array of (term, positions) of the different words of an array, by one sort: equal words stand side by side then, and each run of them is cut out."""

    def runs(placed: Column) -> Column:
        first = lambda i: (i == 0) | (placed[i]["term"] != placed[i - 1]["term"])
        begins = F.filter(F.sequence(F.lit(0), F.size(placed) - 1), first)
        run = lambda at, b, e: F.struct(placed[b]["term"].alias("term"), F.transform(F.slice(placed, b + 1, e - b), lambda x: x["position"]).alias("positions"))
        some = let(begins, lambda at: F.transform(at, lambda b, n: run(at, b, F.coalesce(F.get(at, n + 1), F.size(placed)))))
        return F.when(F.size(placed) > 0, some)

    return let(F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("term"), i.alias("position")))), runs)


def parse_queries(queries: DataFrame) -> DataFrame:
    """Web-style queries (query_id, text) as rows: query_id, clause (any clause suffices: OR), term (a stem), kind (must, not), and
    the phrase with the term's place in it, for quoted words. Stop words are dropped outside phrases' places."""
    parts = F.regexp_extract_all("text", F.lit(r'-?"[^"]*"|\S+'), F.lit(0))
    raw = queries.select("query_id", F.posexplode(parts).alias("at", "part"))
    clause = F.sum(F.when(F.col("part") == "OR", 1).otherwise(0)).over(Window.partitionBy("query_id").orderBy("at"))
    rows = raw.withColumn("clause", clause).filter("part <> 'OR'")
    kind = F.when(F.startswith("part", F.lit("-")), "not").otherwise("must")
    phrase = F.when(F.contains("part", F.lit('"')), F.col("at"))
    out = rows.select("query_id", F.col("clause").cast("int").alias("clause"), kind.alias("kind"), phrase.alias("phrase"), F.posexplode(terms(F.col("part"))).alias("place", "term"))
    return written(out.filter(~F.col("term").isin(*STOP)).withColumn("term", stem(F.col("term"))), "queries")


def match_score(postings: DataFrame) -> Column:
    weight = F.coalesce(*(F.when(F.col("field") == k, F.lit(w)) for k, w in WEIGHTS.items()))
    return weight * F.col("tf")


def keyword_search(queries: DataFrame, postings: DataFrame, k: int = 20, candidates: DataFrame | None = None) -> DataFrame:
    """Top k documents of each query: query_id, doc_id, score, rank. A clause needs all its words and phrases and none
    of its negated ones; the score is the sum of field weight x tf over the words it needs, times 1 + 1 / n where two different ones of
    them stand n words apart at the nearest; the best clause counts.

    The query terms meet postings in one join on term: few terms are broadcast by Spark itself (it knows their size), many are
    shuffled. candidates limits the documents (doc_id), for filters.
    """
    asked = parse_queries(queries)
    wanted = _wanted(asked)
    hits = wanted.select("query_id", "clause", "term").distinct().join(postings, "term")
    if candidates is not None:
        hits = hits.join(candidates.select("doc_id").distinct(), "doc_id", "left_semi")
    return top_k(_scored(asked, hits, postings), k)


def _wanted(asked: DataFrame) -> DataFrame:
    return asked.filter("kind = 'must'").select("query_id", "clause", "phrase", "place", "term").distinct()


def _scored(asked: DataFrame, hits: DataFrame, postings: DataFrame) -> DataFrame:
    """query_id, doc_id and score of the documents among hits (postings of the words that clauses need) that meet all of a clause.

    A clause's hits in a document, and those of its negated words, meet in one row, where all is decided. A clause of one word needs sums only; positions
    go along where a clause has several words or a phrase.
    """
    wanted = _wanted(asked)
    need = wanted.groupBy("query_id", "clause").agg(F.count_distinct("term").alias("need"))
    phrase = wanted.filter("phrase IS NOT NULL").groupBy("query_id", "clause", "phrase").agg(F.collect_set(F.struct("place", "term")).alias("words"))
    need = need.join(phrase.groupBy("query_id", "clause").agg(F.collect_list("words").alias("phrases")), ["query_id", "clause"], "left")
    need = written(need.withColumn("plain", (F.col("need") == 1) & F.col("phrases").isNull()), "clauses")
    keys = ["query_id", "clause", "doc_id"]
    post = F.struct("term", F.coalesce(*(F.when(F.col("field") == k, F.lit(i)) for i, k in enumerate(WEIGHTS))).alias("field"), "positions")
    each = hits.join(need.select("query_id", "clause", "plain"), ["query_id", "clause"]).select(*keys, "plain", match_score(postings).alias("s"), F.when(~F.col("plain"), post).alias("post"), F.lit(False).alias("bad"))
    banned = asked.filter("kind = 'not'").select("query_id", "clause", "term").distinct().join(need.select("query_id", "clause", "plain"), ["query_id", "clause"])
    banned = banned.join(postings.select("term", "doc_id"), "term").select(*keys, "plain", F.lit(0.0).alias("s"), F.lit(None).cast(each.schema["post"].dataType).alias("post"), F.lit(True).alias("bad"))
    rows = each.unionByName(banned)
    alone = rows.filter("plain").groupBy(*keys).agg(F.sum("s").alias("score"), F.max("bad").alias("bad")).filter("NOT bad")
    several = rows.filter("NOT plain").groupBy(*keys).agg(F.sum("s").alias("score"), F.max("bad").alias("bad"), F.collect_list("post").alias("posts")).filter("NOT bad").join(need, ["query_id", "clause"])
    several = several.filter(F.size(F.array_distinct(F.transform("posts", lambda p: p["term"]))) == F.col("need"))
    several = several.filter(F.col("phrases").isNull() | F.forall("phrases", lambda words: _spoken(F.col("posts"), words)))
    apart = F.when(F.col("need") > 1, _apart(F.col("posts")))
    several = several.select(*keys, (F.col("score") * (1 + F.coalesce(1 / apart, F.lit(0.0)))).alias("score"))
    return alone.select(*keys, "score").unionByName(several).groupBy("query_id", "doc_id").agg(F.round(F.max("score"), 6).alias("score"))


def _spoken(posts: Column, words: Column) -> Column:
    """Whether the words (place, term) of a phrase stand one after the other in a field of posts (term, field, positions)."""

    def starts(word: Column) -> Column:
        at = lambda p: F.transform(p["positions"], lambda x: p["field"] * F.lit(1 << 33) + x - word["place"])
        return F.flatten(F.transform(F.filter(posts, lambda p: p["term"] == word["term"]), at))

    rest = F.slice(words, F.lit(2), F.size(words))
    return F.size(F.aggregate(rest, starts(F.get(words, F.lit(0))), lambda some, word: F.array_intersect(some, starts(word)))) > 0


def _apart(posts: Column) -> Column:
    """How many words apart the nearest two different ones of posts (term, field, positions) stand in a field; null where no field has two."""
    placed = F.sort_array(F.flatten(F.transform(posts, lambda p: F.transform(p["positions"], lambda x: F.struct(p["field"].alias("f"), x.alias("x"), p["term"].alias("t"))))))
    gap = lambda a, b: F.when((a["f"] == b["f"]) & (a["t"] != b["t"]), b["x"] - a["x"])
    return let(placed, lambda all_: F.array_min(F.zip_with(all_, F.slice(all_, F.lit(2), F.size(all_)), gap)))


#: Documents of a block of postings; blocks of a query that are read before any is skipped.
BLOCK, FIRST_BLOCKS = 256, 4


def block_tops(postings: DataFrame, size: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """An index for block_search: postings with the block of their document, and for each term and block how many postings it has and
    the most that one document there can score for the term (term, block, n, top)."""
    blocked = postings.withColumn("block", F.floor(F.col("doc_id") / size))
    each = blocked.groupBy("term", "block", "doc_id").agg(F.sum(match_score(postings)).alias("score"), F.count(F.lit(1)).alias("n"))
    return blocked, each.groupBy("term", "block").agg(F.sum("n").alias("n"), F.max("score").alias("top"))


def block_search(queries: DataFrame, blocked: DataFrame, tops: DataFrame, k: int = 20) -> DataFrame:
    """keyword_search over an index of block_tops, with the same rows, reading only blocks that can matter.

    A block can matter to a clause if it has all of the clause's words; no document in it can score over the sum of its words' tops, twice that if words may stand next
    to each other. Each query's blocks are read from the highest bound down, in waves that grow eightfold; after a wave the query's
    k-th score so far rules out all blocks whose bound is lower. The rows to be joined are those of (term, block), so a word that stands in
    every document is dealt over as many tasks as it has blocks.
    """
    asked = parse_queries(queries)
    words_ = _wanted(asked).select("query_id", "clause", "term").distinct()
    need = words_.groupBy("query_id", "clause").agg(F.count(F.lit(1)).alias("need"))
    bounds = words_.join(tops, "term").groupBy("query_id", "clause", "block").agg(F.count(F.lit(1)).alias("have"), F.sum("top").alias("bound")).join(need, ["query_id", "clause"]).filter("have = need")
    bounds = bounds.withColumn("bound", F.col("bound") * F.when(F.col("need") > 1, 2.0).otherwise(1.0))
    turn = Window.partitionBy("query_id").orderBy(F.desc("bound"), "clause", "block")
    left = written(bounds.select("query_id", "clause", "block", "bound").withColumn("turn", F.row_number().over(turn)), "block-bounds")
    best, read = None, FIRST_BLOCKS
    while not left.isEmpty():
        now = left.filter(F.col("turn") <= read)
        hits = now.select("query_id", "clause", "block").join(words_, ["query_id", "clause"]).join(blocked, ["term", "block"])
        # a document is in one block, so a wave has all of a clause's postings of it
        found = _scored(asked, hits, blocked).select("query_id", "doc_id", "score")
        both = found if best is None else best.select("query_id", "doc_id", "score").unionByName(found)
        best = written(top_k(both.groupBy("query_id", "doc_id").agg(F.max("score").alias("score")), k), "best")
        floor = best.filter(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
        rest = left.filter(F.col("turn") > read).join(floor, "query_id", "left")
        left = written(rest.filter(F.col("floor").isNull() | (F.col("bound") + 1e-6 >= F.col("floor"))).drop("floor"), "block-bounds")
        read *= 8
    if best is None:
        return top_k(_scored(asked, words_.join(blocked, "term"), blocked), k)
    return best


def top_k(scored: DataFrame, k: int, by: str = "query_id", id: str = "doc_id") -> DataFrame:
    """The k best rows of each query by score, ties by id; Spark cuts to k inside each task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), F.asc(id)))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def highlight(text: Column, words: Column, around: int = 20, fragments: int = 2) -> Column:
    """Up to `fragments` pieces of 2 * around words: about the first hit, about the first hit after that piece, and so on, with
    dots between; hits in <mark>; the beginning if there is none."""
    bare = lambda w: F.regexp_replace(F.lower(w), r"[^\p{L}\p{N}]", "")

    def chosen(tokens: Column) -> Column:
        """Where the pieces begin."""
        hits = F.filter(F.transform(tokens, lambda w, i: F.when(F.array_contains(words, bare(w)), i + 1)), lambda i: i.isNotNull())

        def step(starts: Column, hit: Column) -> Column:
            free = F.coalesce(F.get(starts, F.size(starts) - 1) + 2 * around, F.lit(1))  # after the piece before
            more = (F.size(starts) < fragments) & (hit >= free)
            return F.when(more, F.concat(starts, F.array(F.greatest(free, hit - around)))).otherwise(starts)

        found = F.aggregate(hits, F.array().cast("array<int>"), step)
        return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(1)))

    def marked(w: Column) -> Column:
        return F.when(F.array_contains(words, bare(w)), F.concat(F.lit("<mark>"), w, F.lit("</mark>"))).otherwise(w)

    def pieces(tokens: Column) -> Column:
        shown = lambda at: F.array_join(F.transform(F.slice(tokens, at, 2 * around), marked), " ")
        return let(chosen(tokens), lambda starts: F.array_join(F.transform(starts, shown), " ... "))

    return F.when(text.isNotNull(), let(F.filter(F.split(text, r"\s+"), lambda w: w != ""), pieces))


def semantic_search(queries: DataFrame, corpus: DataFrame, k: int = 20, query_id: str = "query_id", id: str = "doc_id", vector: str = "embedding", least: float | None = None, before: str | None = None, effort: list | None = None) -> DataFrame:
    """Top k rows of corpus for each query by cosine: query_id, id, score, rank. Null and zero vectors are left out.

    See nearest: cells around pivots leave out what cannot be near; queries come in blocks of QUERY_BLOCK, whose size has a bound on the
    driver too. before names a column of both tables: a row counts only where its value is less than the query's. least
    drops scores that are not over it.
    """
    moment = F.col(before).cast("double") if before else F.lit(0.0)
    vectors = lambda df, name, alias: df.select(F.col(name).alias(alias), F.col(vector).cast("array<double>").alias("v"), moment.alias("t")).filter(F.col("v").isNotNull() & F.exists("v", lambda x: x != 0))
    found = nearest(vectors(queries, query_id, "q"), vectors(corpus, id, "id"), k, before is not None, least, QUERY_BLOCK, effort)
    return found.select(F.col("q").alias(query_id), F.col("id").alias(id), "score", "rank")


def hybrid_search(keyword: DataFrame, semantic: DataFrame, wk: float = 0.4, ws: float = 0.6, k: int = 60, limit: int = 20) -> DataFrame:
    """Fuse two ranked lists (query_id, doc_id, rank) by reciprocal ranks: query_id, doc_id, score (6 places), rank. Ties keep the keyword order."""
    cut = min(3 * limit, 100)
    a, b = (x.filter(F.col("rank") <= cut).select("query_id", "doc_id", F.col("rank").alias(name)) for x, name in ((keyword, "rk"), (semantic, "rs")))
    both = a.join(b, ["query_id", "doc_id"], "full_outer")
    part = lambda w, r: F.coalesce(F.lit(w) / (F.lit(k) + F.col(r)), F.lit(0.0))
    scored = both.withColumn("score", F.round(part(wk, "rk") + part(ws, "rs"), 6))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("rk"), F.asc_nulls_last("rs"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select("query_id", "doc_id", "score", "rank")


def apply_filters(rows: DataFrame, category: str | None = None, source_file: int | None = None, date_from: str | None = None, date_to: str | None = None, entities: list[str] | None = None, tags: list[str] | None = None, links: DataFrame | None = None) -> DataFrame:
    """category and source file equal; created from date_from to the end of date_to; all named entities (array names) present; any of the tags
    by the bridge links (file_id, name)."""
    out = rows
    if category is not None:
        out = out.filter(F.col("category") == category)
    if source_file is not None:
        out = out.filter(F.col("source_file_id") == source_file)
    if date_from is not None:
        out = out.filter(F.col("created_at") >= F.lit(date_from).cast("date"))
    if date_to is not None:
        out = out.filter(F.col("created_at") < F.date_add(F.lit(date_to).cast("date"), 1))
    for name in entities or []:
        out = out.filter(F.array_contains("names", name))
    if tags and links is not None:
        tagged = links.filter(F.col("name").isin(*tags)).select(F.col("file_id").alias("source_file_id")).distinct()
        out = out.join(tagged, "source_file_id", "left_semi")
    return out


def recent_documents(documents: DataFrame, most: int) -> DataFrame:
    """For a blank query: the newest current documents, score 0."""
    return documents.filter("is_current").orderBy(F.desc("created_at"), F.desc("doc_id")).limit(most).withColumn("score", F.lit(0.0))


def _all_words(queries: DataFrame, joint: str) -> DataFrame:
    """Queries from their words: all of them, or (joint OR) up to ten of more than two letters."""
    words = terms(F.col("text"))
    if joint == "OR":
        words = F.slice(F.filter(words, lambda w: F.char_length(w) > 2), 1, 10)
    return queries.select("query_id", F.array_join(words, f" {joint} ".replace("  ", " ")).alias("text"))


def search_with_fallback(queries: DataFrame, documents: DataFrame, postings: DataFrame, k: int = 10) -> DataFrame:
    """For each query the first of four searches that finds something: as typed; all words; any word; the text's first 100 characters inside title,
    summary or body, newest first. query_id, doc_id, rank, stage.

    Later stages run only for queries that have nothing yet.
    """
    rest, out = queries, None
    for stage in range(1, 4):
        asked = rest if stage == 1 else _all_words(rest, "" if stage == 2 else "OR")
        hits = written(keyword_search(asked, postings, k).select("query_id", "doc_id", "rank", F.lit(stage).alias("stage")), "stage")
        out = hits if out is None else out.unionByName(hits)
        rest = written(rest.join(hits.select("query_id").distinct(), "query_id", "left_anti"), "rest")
        if rest.isEmpty():
            return out
    low = rest.select("query_id", F.lower(F.substring("text", 1, 100)).alias("needle")).filter("needle <> ''")
    text = F.lower(F.concat_ws("\n", "title", "summary", "body"))
    current = documents.filter("is_current").select("doc_id", "created_at", text.alias("hay"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("created_at"), F.desc("doc_id")))
    last = containing(low, current).select("query_id", "doc_id", rank.alias("rank"), F.lit(4).alias("stage")).filter(F.col("rank") <= k)
    return out.unionByName(last)


def _first_chunks(chunks: DataFrame, wanted: DataFrame, most: int) -> DataFrame:
    """The first chunks of the wanted documents; the others' are not sorted."""
    there = chunks.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    return there.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_index"))).filter(F.col("n") <= most)


def retrieve_chunks(hits: DataFrame, chunks: DataFrame, documents: int = 8, per_document: int = 5, chars: int = 1500) -> DataFrame:
    """The first chunks of the best documents of each query."""
    best = hits.filter(F.col("rank") <= documents).select("query_id", "doc_id", "rank")
    return best.join(_first_chunks(chunks, best, per_document), "doc_id").select("query_id", "doc_id", "rank", "chunk_index", F.substring("content", 1, chars).alias("content"))


def follow_up_chunks(found: DataFrame, hits: DataFrame, chunks: DataFrame, documents: int = 5, per_document: int = 3) -> DataFrame:
    """Chunks for follow-up queries (hits with query_id and follow_up, 3 at most), documents already used left out."""
    few = hits.filter((F.col("follow_up") <= 3) & (F.col("rank") <= documents))
    new = few.join(found.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_anti")
    once = new.groupBy("query_id", "doc_id").agg(F.min("follow_up").alias("follow_up"))
    return once.join(_first_chunks(chunks, once, per_document), "doc_id").select("query_id", "follow_up", "doc_id", "chunk_index")


def related_questions(questions: DataFrame, k: int = 5, least: float = 0.7) -> DataFrame:
    """For each question (id, embedding, created_at) its nearest earlier ones over `least`."""
    pairs = semantic_search(questions.withColumnRenamed("id", "query_id"), questions.withColumnRenamed("id", "doc_id"), k, least=least, before="created_at")
    return pairs.withColumn("score", F.round("score", 3))
