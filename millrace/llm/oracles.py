"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

EXACT_DEDUP = f"""
WITH t AS (SELECT doc_id, {LOWER.format("coalesce(text, '')")} AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g USING (norm)
"""

MIXING = r"""
WITH d AS (
  SELECT doc_id, source, length(text) AS chars,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ((('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
k AS (
  SELECT doc_id, source, size,
         -ln(u) / coalesce(greatest(size, 1)::DOUBLE / (greatest(size, 1) + 50)::DOUBLE * CASE WHEN chars BETWEEN 3 * size AND 13 * size THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END, 0.001::DOUBLE) AS key
  FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
w AS (SELECT *, ([5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE])[1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3] AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (
  SELECT *, sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
         ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
t AS (
  SELECT source, source_size, coalesce(least(cap, weight * (SELECT max_by(level, rest) FROM l WHERE cap / weight >= level)), cap) AS target FROM l),
p AS (
  SELECT doc_id, size, source_size, target,
         CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs,
         coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, floor(target - epochs * source_size)::BIGINT - before)))::BIGINT AS taken
FROM p
"""

LOWER_HOST = LOWER.format("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')")


def _ranks(name: str, seed: str, source: str, target: str, rounds: int = 43) -> str:
    """Common table expressions for personalised PageRank, a round each (43: 0.85 ** 43 < 0.001); the last is {name}{rounds}."""
    parts = [
        f"{name}s AS (SELECT host, {seed}::DOUBLE / (SELECT sum({seed}) FROM hosts) * (1 - 0.85::DOUBLE) AS rank FROM hosts WHERE {seed} > 0)",
        f"{name}e AS (SELECT {source} AS a, {target} AS b, weight / sum(weight) OVER (PARTITION BY {source}) * 0.85::DOUBLE AS step FROM edges)",
        f"{name}0 AS (SELECT * FROM {name}s)",
    ]
    for i in range(rounds):
        parts.append(f"{name}{i + 1} AS MATERIALIZED (SELECT host, sum(rank) AS rank FROM (SELECT b AS host, rank * step AS rank FROM {name}e JOIN {name}{i} ON a = host UNION ALL SELECT * FROM {name}s) GROUP BY host)")
    return ",\n".join(parts)


URL_FILTER = rf"""
WITH p AS (
  SELECT page_id, {LOWER_HOST} AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, html FROM pages),
r AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule FROM p),
j AS (SELECT *, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS ruled FROM r),
c AS (SELECT host, count(*) FILTER (ruled = 'allow') AS allowed, count(*) FILTER (ruled = 'block') AS bad FROM j WHERE host <> '' GROUP BY host),
hosts AS (SELECT host, bad, CASE WHEN bad = 0 THEN allowed ELSE 0 END AS good FROM c),
x AS (
  SELECT page_id, host, unnest(list_distinct([{LOWER.format("h")} FOR h IN regexp_extract_all(html, '(?is)<(?:a|area|link|base|iframe|frame|form)\s[^>]*?(?:href|src|action)\s*=\s*["'']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"''\s>]+)', 1)])) AS target FROM p),
links AS (SELECT host AS source, target, count(*)::DOUBLE AS weight FROM x WHERE host <> '' AND target <> '' AND host <> target GROUP BY 1, 2),
s AS (SELECT host, string_split(host, '.') AS l FROM hosts WHERE NOT regexp_full_match(host, '[0-9.]+(:[0-9]+)?')),
u AS (SELECT l, unnest(range(2, len(l))) AS n FROM s),
names AS (SELECT DISTINCT array_to_string(l[len(l) - n :], '.') AS child, array_to_string(l[len(l) - n + 1 :], '.') AS parent FROM u),
edges AS (
  SELECT source, target, sum(weight) AS weight FROM (
    SELECT * FROM links UNION ALL SELECT child, parent, 1.0::DOUBLE FROM names UNION ALL SELECT parent, child, 1.0::DOUBLE FROM names)
  GROUP BY 1, 2),
{_ranks("t", "good", "source", "target")},
{_ranks("d", "bad", "target", "source")},
standing AS (
  SELECT host, coalesce(t43.rank, 0) AS t, coalesce(d43.rank, 0) AS d FROM hosts LEFT JOIN t43 USING (host) LEFT JOIN d43 USING (host)),
out AS (SELECT j.*, round(coalesce(CASE WHEN t + d > 0 THEN (t - d) / (t + d) ELSE 0.0::DOUBLE END, 0.0::DOUBLE), 6) AS standing FROM j LEFT JOIN standing USING (host))
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN standing < 0 THEN 'block' ELSE 'allow' END) AS verdict, standing FROM out
"""

TERMS = "regexp_extract_all(" + LOWER.format("text") + r", '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

SEARCH = rf"""
WITH d AS (SELECT doc_id, {TERMS} AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({TERMS}) AS term FROM benchmark) GROUP BY 1, 2),
c AS (SELECT count(*) AS n_docs, coalesce(sum(len(w)), 0)::BIGINT AS n_terms FROM d WHERE len(w) > 0),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY 1, 2, 3),
f AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS weight FROM (SELECT term, count(*) AS df FROM p GROUP BY 1), c),
s AS (
  SELECT item_id, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM p JOIN f USING (term) JOIN i USING (term), c GROUP BY 1, 2)
SELECT * FROM (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0) WHERE rank <= 20
"""

SUBSTRINGS = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
p AS (SELECT doc_id, w[i] AS word, i, CASE WHEN i + 49 <= len(w) THEN md5(array_to_string(w[i:i + 49], ' ')) END AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
f AS (SELECT win, min(doc_id) AS first FROM p WHERE win IS NOT NULL GROUP BY win HAVING min(doc_id) < max(doc_id)),
m AS (SELECT p.doc_id, word, i, max(CASE WHEN first < p.doc_id THEN i END) OVER (PARTITION BY p.doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone FROM p LEFT JOIN f USING (win)),
k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM m GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""

ORACLES: dict[str, str] = {
    "op3_mixing": MIXING,
    "op8_url_filter": URL_FILTER,
    "op9_exact_dedup": EXACT_DEDUP,
    "op11_search": SEARCH,
    "op12_substrings": SUBSTRINGS,
}
