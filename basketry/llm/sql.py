"""The queries in DuckDB SQL, where SQL can express them."""

from __future__ import annotations

LINE_DEDUP = r"""
WITH split AS (
    SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), line AS (
    SELECT doc_id, pos, lines[pos] AS line,
           translate(regexp_extract(lines[pos], '^[\x20\x09-\x0D]*((?s:.*?))[\x20\x09-\x0D]*$', 1),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS pos FROM split)
), held AS (
    SELECT key, min(doc_id) AS least FROM line WHERE length(key) >= 10
    GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), marked AS (
    SELECT line.*, coalesce(held.least <> line.doc_id, false) AS gone
    FROM line LEFT JOIN held USING (key)
)
SELECT doc_id, count(*) AS n_lines,
       CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

TOP_K = r"""
WITH whole AS (
    SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
    FROM embeddings
    WHERE embedding IS NOT NULL
      AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), pair AS (
    SELECT q.vec_id AS query_id, c.vec_id,
           CAST(list_sum([a * c.v[i] FOR a, i IN q.v]) AS BIGINT) AS score
    FROM whole q JOIN whole c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
    WHERE q.vec_id % 50 = 0
), ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
    FROM pair
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

NEAR_DEDUP = r"""
WITH RECURSIVE usable AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
      AND list_sum([x * x FOR x IN CAST(embedding AS DOUBLE[])]) > 0
), link AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b USING (label)
    WHERE a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.98
), reach AS (
    SELECT vec_id AS node, vec_id AS low FROM embeddings
    UNION
    SELECT link.b, reach.low FROM reach JOIN link ON link.a = reach.node WHERE reach.low < link.b
), least AS (
    SELECT node, min(low) AS component_id FROM reach GROUP BY node
), counted AS (
    SELECT a, count(*) AS n FROM link GROUP BY a
)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least ON node = vec_id LEFT JOIN counted ON a = vec_id
"""

def _product_codes(rounds: int = 4, entries: int = 256) -> str:
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
, code{k} AS MATERIALIZED (
    SELECT part.vec_id, part.part, min({{'away': CAST(list_sum([(x - book.v[i]) * (x - book.v[i]) FOR x, i IN part.v]) AS BIGINT),
                                         'entry': book.entry}}) AS best
    FROM part JOIN book{k} AS book USING (part) GROUP BY part.vec_id, part.part
)""")
        if k < rounds:
            steps.append(f"""
, mean{k} AS (
    SELECT part, entry, list(CAST(mean AS BIGINT) ORDER BY place) AS v
    FROM (SELECT part, best.entry AS entry, place, floor(sum(v[place]) / count(*)) AS mean
          FROM part JOIN code{k} USING (vec_id, part), unnest(range(1, len(v) + 1)) AS u(place)
          GROUP BY part, best.entry, place)
    GROUP BY part, entry
), book{k + 1} AS MATERIALIZED (
    SELECT part, entry, coalesce(mean{k}.v, book{k}.v) AS v FROM book{k} LEFT JOIN mean{k} USING (part, entry)
)""")
    return f"""
WITH whole AS MATERIALIZED (
    SELECT vec_id, label, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
    FROM embeddings
    WHERE embedding IS NOT NULL
      AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), part AS MATERIALIZED (
    SELECT vec_id, part, v[part * (len(v) // 4) + 1 : (part + 1) * (len(v) // 4)] AS v
    FROM whole, range(4) AS p(part)
), book0 AS MATERIALIZED (
    SELECT part, entry, v
    FROM part JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM whole) USING (vec_id)
    WHERE entry < {entries}
){"".join(steps)}
, done AS (
    SELECT vec_id, string_agg(lower(printf('%02x', best.entry)), '' ORDER BY part) AS code,
           CAST(sum(best.away) AS BIGINT) AS error
    FROM code{rounds} GROUP BY vec_id
), said AS (
    SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{rounds}
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM done JOIN whole USING (vec_id), said
"""


PRODUCT_CODES = _product_codes()

SUFFIX_DEDUP = """
WITH doc AS (
    SELECT doc_id, hex(encode(coalesce(text, ''))) AS bytes FROM documents
), string AS MATERIALIZED (
    SELECT doc_id, p, md5(substr(bytes, 2 * p + 1, 200)) AS said
    FROM (SELECT doc_id, bytes, unnest(range(length(bytes) // 2 - 99)) AS p FROM doc)
), first AS (
    SELECT said, min({'doc': doc_id, 'p': p}) AS place FROM string GROUP BY said HAVING count(*) > 1
), repeated AS (
    SELECT doc_id, p, coalesce(p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100, true) AS begins
    FROM string JOIN first USING (said) WHERE place <> {'doc': doc_id, 'p': p}
), numbered AS (
    SELECT doc_id, p, sum(CAST(begins AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM repeated
), span AS (
    SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM numbered GROUP BY doc_id, run
), ahead AS (
    SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b, b - a AS gone FROM span
    UNION ALL
    SELECT doc_id, coalesce(max(span.b), 0), length(any_value(bytes)) // 2, NULL
    FROM doc LEFT JOIN span USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, any_value(length(bytes) // 2) AS n_bytes, CAST(coalesce(sum(gone), 0) AS BIGINT) AS n_removed,
       count(gone) AS n_spans,
       sha256(unhex(string_agg(substr(bytes, 2 * a + 1, 2 * (b - a)), '' ORDER BY a))) AS kept_sha256
FROM ahead JOIN doc USING (doc_id) GROUP BY doc_id
"""
