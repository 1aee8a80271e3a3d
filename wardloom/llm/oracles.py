"""DuckDB SQL for the queries that SQL can express."""

from .secrets import BASE, RULES, Rule

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACE = r"[^\x20\x09-\x0D]+"

OP3 = f"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all({LOWER.format("text")}, '{ALNUM}'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOWER.format("text")}, '{ALNUM}') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
g AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS gram
      FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
k AS (SELECT DISTINCT k FROM g),
s AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS gram
      FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, k WHERE len(w) >= k)),
h AS (SELECT s.doc_id, s.k, s.i, g.item_id FROM s JOIN g USING (k, gram)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""

OP4 = f"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '{SPACE}'), []) AS w FROM documents),
s AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT gram, min(doc_id) AS first FROM s GROUP BY gram),
r AS (SELECT doc_id, list_sort(list(DISTINCT p)) AS gone FROM (SELECT s.doc_id, unnest(range(i, i + 13)) AS p FROM s JOIN f USING (gram) WHERE f.first < s.doc_id) GROUP BY doc_id),
t AS (SELECT doc_id, p, w[p] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
x AS (SELECT doc_id, unnest(gone) AS p FROM r),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM t ANTI JOIN x USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id) LEFT JOIN k USING (doc_id)
"""

OP7 = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[64] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, array_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 20
"""



def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _matches(n: int, rule: Rule) -> str:
    """The matches of a rule, from the lengths of what lies between them."""
    pattern, kept = _quoted(rule.pattern), f"regexp_matches(m, {_quoted(rule.kept)})" if rule.kept else "true"
    return f"""SELECT doc_id, '{rule.kind}' AS kind, {n} AS n, e - length(m) AS s, e FROM (
      SELECT *, sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM (
        SELECT doc_id, unnest(f) AS m, unnest(b[:len(f)]) AS g, unnest(range(len(f))) AS i
        FROM (SELECT doc_id, regexp_extract_all(text, {pattern}) AS f, string_split_regex(text, {pattern}) AS b FROM documents WHERE regexp_matches(text, {pattern})))) WHERE {kept}"""


_BASE = ", ".join(f"'{r.kind}'" for r in BASE)
_LIST = "string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, n)"
OP5 = f"""
WITH m AS ({" UNION ALL ".join(_matches(n, r) for n, r in enumerate(RULES))}),
a AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)}, {_LIST} FILTER (kind IN ({_BASE})) AS base, {_LIST} AS spans FROM m GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN a USING (doc_id)
"""

OP9 = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all({LOWER.format("text")}, '{SPACE}'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(3, len(w)) - 1], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(3, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 90 * (a.n + b.n - i)),
r AS (SELECT doc_id AS node, doc_id AS reached FROM documents UNION SELECT r.node, l.y FROM r JOIN l ON l.x = r.reached),
c AS (SELECT node, min(reached) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM d LEFT JOIN n USING (doc_id) JOIN c ON c.node = d.doc_id
"""

OP11 = f"""
WITH t AS (SELECT doc_id, {LOWER.format("coalesce(text, '')")} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256 FROM t WINDOW w AS (PARTITION BY t)
"""

ORACLES: dict[str, str] = {
    "op3_decontamination": OP3,
    "op4_substring_dedup": OP4,
    "op5_secrets": OP5,
    "op9_jaccard_join": OP9,
    "op11_exact_dedup": OP11,
    "op7_nearest_neighbours": OP7,
}
