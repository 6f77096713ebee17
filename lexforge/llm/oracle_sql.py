"""DuckDB SQL that gives the same rows as the queries, where SQL can."""

from __future__ import annotations

from . import line_dedup, ngram_join

_WORDS = r"regexp_extract_all(lower({}), '[^\x00-/:-@\[-^`{{-\x7f]+')"

#: Brute force but for the prefixes: elements by their exact frequency, so in another order than the query's.
_SIMILAR = """
rep AS (SELECT sig, min(pos) AS pos, len(sig) AS n FROM units GROUP BY sig),
element AS (SELECT row_number() OVER (ORDER BY pos) AS id, pos, n, sig FROM rep),
single AS (SELECT id, n, unnest(sig) AS e FROM element),
counted AS (SELECT e, count(*) AS f FROM single GROUP BY e),
placed AS (SELECT id, n, e, row_number() OVER (PARTITION BY id ORDER BY f, e) AS k FROM single JOIN counted USING (e)),
prefix AS (SELECT id, n, e FROM placed WHERE k <= n - ceil({t} * n - 1e-9) + 1),
pair AS (SELECT DISTINCT x.id AS a, y.id AS b FROM prefix x JOIN prefix y ON x.e = y.e AND x.id < y.id AND x.n >= {t} * y.n - 1e-9 AND y.n >= {t} * x.n - 1e-9),
common AS (SELECT a, b, len(list_intersect(x.sig, y.sig)) AS c, x.n AS m, y.n AS n, x.pos AS p, y.pos AS q FROM pair JOIN element x ON a = x.id JOIN element y ON b = y.id),
verified AS (SELECT p, q, c / (m + n - c)::DOUBLE AS jaccard FROM common WHERE c / (m + n - c)::DOUBLE >= {t})
"""


def line_sql(threshold: float = line_dedup.THRESHOLD) -> str:
    return f"""
WITH line AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line_text, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents),
units AS (
  SELECT doc_id, line, {{'doc': doc_id, 'line': line}} AS pos, list_sort(list_distinct({_WORDS.format("line_text")})) AS sig FROM line
  WHERE len({_WORDS.format("line_text")}) > 0),
{_SIMILAR.format(t=threshold)},
first AS (SELECT sig, pos FROM rep),
matched AS (
  SELECT p AS own, q AS pos, jaccard FROM verified UNION ALL SELECT q, p, jaccard FROM verified UNION ALL SELECT pos, pos, 1.0 FROM first),
best AS (SELECT own, min({{'pos': pos, 'jaccard': jaccard}}) AS m FROM matched GROUP BY own)
SELECT doc_id, line::INTEGER AS line, m.pos.doc AS match_doc_id, m.pos.line::INTEGER AS match_line, m.jaccard AS jaccard
FROM units JOIN first USING (sig) JOIN best ON best.own = first.pos
WHERE m.pos < units.pos"""


def ngram_sql(n: int = ngram_join.N, threshold: float = ngram_join.THRESHOLD) -> str:
    return f"""
WITH worded AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents WHERE len({_WORDS.format("text")}) > 0),
units AS (
  SELECT doc_id, doc_id AS pos, list_sort(list_distinct(
    CASE WHEN len(w) < {n} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n} - 1], ' ')) END)) AS sig FROM worded),
{_SIMILAR.format(t=threshold)},
sides AS (SELECT p, q, jaccard FROM verified UNION ALL SELECT q, p, jaccard FROM verified),
best AS (SELECT p, count(*) AS links, min({{'at': q, 'jaccard': jaccard}}) AS m FROM sides GROUP BY p),
class AS (SELECT sig, min(pos) AS class_id, count(*) AS copies FROM units GROUP BY sig)
SELECT doc_id, class_id, copies, coalesce(links, 0)::BIGINT AS links, m.at AS match_doc_id, coalesce(m.jaccard, 1.0) AS jaccard
FROM units JOIN class USING (sig) LEFT JOIN best ON p = class_id WHERE copies > 1 OR links IS NOT NULL"""
