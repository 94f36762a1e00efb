"""DuckDB SQL for the queries of this folder that SQL can express on whole tables."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _low(column: str) -> str:
    return f"translate(coalesce({column}, ''), '{UPPER}', '{LOWER}')"


_ALNUM_WORDS = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPACE_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"

_TERMS = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP6 = f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ALNUM_WORDS.format(_low('text'))} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(w[k : k + least(len(w), 10) - 1], ' ') AS words
  FROM items, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS r(k) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM windows),
docs AS (SELECT doc_id, {_ALNUM_WORDS.format(_low('text'))} AS w FROM documents),
places AS (
  SELECT doc_id, size, k, array_to_string(w[k : k + size - 1], ' ') AS words
  FROM docs, sizes, unnest(range(1, len(w) - size + 2)) AS r(k)),
met AS (SELECT doc_id, size, k, item FROM places JOIN windows USING (size, words)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, size, k FROM met), unnest(range(k, k + size)) AS r(p) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT doc_id, item FROM met) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN found USING (doc_id)
"""

OP7 = f"""
WITH RECURSIVE docs AS (SELECT doc_id, {_SPACE_WORDS.format(_low('text'))} AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[k : k + 4], ' ') AS s
  FROM docs, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS r(k) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT DISTINCT a AS doc, a AS node FROM ways UNION SELECT reach.doc, ways.b FROM reach JOIN ways ON ways.a = reach.node),
least AS (SELECT doc, min(node) AS component FROM reach GROUP BY doc)
SELECT docs.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(component, docs.doc_id) AS component_id
FROM docs LEFT JOIN sizes USING (doc_id) LEFT JOIN least ON least.doc = docs.doc_id
"""

OP11 = f"""
WITH docs AS (
  SELECT row_number() OVER () AS d, doc_id, {_TERMS.format(_low('text'))} AS w FROM documents),
totals AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM docs WHERE len(w) > 0),
asked AS (SELECT DISTINCT i, item_id, unnest(w) AS t FROM (SELECT row_number() OVER () AS i, item_id, {_TERMS.format(_low('text'))} AS w FROM benchmark)),
counts AS (
  SELECT d, t, count(*) AS tf FROM (SELECT d, unnest(w) AS t FROM docs) WHERE t IN (SELECT t FROM asked) GROUP BY d, t),
weights AS (
  SELECT t, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS weight FROM counts, totals GROUP BY t),
impacts AS (
  SELECT d, t, weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * len(w) * n_docs) // n_terms))) AS impact
  FROM counts JOIN weights USING (t) JOIN docs USING (d), totals),
scores AS (SELECT i, item_id, d, CAST(sum(impact) AS BIGINT) AS score FROM asked JOIN impacts USING (t) GROUP BY i, item_id, d),
ranked AS (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST) AS rank
  FROM scores JOIN docs USING (d) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""

ORACLES: dict[str, str] = {"op6_decontaminate": OP6, "op7_ngram_join": OP7, "op11_lexical_search": OP11}
