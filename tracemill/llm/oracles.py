"""SQL that gives the same rows as the queries of this subpackage, where SQL can express them on whole tables."""

from __future__ import annotations

#: Windows of 50 bytes as hexadecimal digits, the least doc_id of each, and what is left between the spans that those of larger ones cover.
REPEATS = """WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT r, doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS p FROM d WHERE doc_id IS NOT NULL AND length(h) >= 100)),
lo AS (SELECT s, min(doc_id) AS lo FROM w GROUP BY s),
hit AS (SELECT r, p, p - coalesce(lag(p) OVER (PARTITION BY r ORDER BY p), -1000) > 50 AS new FROM w JOIN lo USING (s) WHERE lo < doc_id),
runs AS (SELECT r, p, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY p) AS g FROM hit),
spans AS (SELECT r, min(p) AS b, max(p) + 50 AS e FROM runs GROUP BY r, g),
edges AS (SELECT r, coalesce(lag(e) OVER (PARTITION BY r ORDER BY b), 0) AS x, b AS y FROM spans UNION ALL SELECT r, max(e), 1000000000 FROM spans GROUP BY r),
kept AS (SELECT r, string_agg(substr(h, 2 * x + 1, 2 * least(y - x, 100000000)), '' ORDER BY x) AS k FROM edges JOIN d USING (r) GROUP BY r),
lost AS (SELECT r, sum(e - b) AS n_removed, count(*) AS n_spans FROM spans GROUP BY r)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN kept USING (r) LEFT JOIN lost USING (r)"""


def clusters(k: int = 40, rounds: int = 5) -> str:
    """Rounds of assignment and means, one after another, on the components in rows."""
    start = f"""WITH whole AS (SELECT row_number() OVER () AS r, vec_id, embedding AS e FROM embeddings WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = 64),
p AS MATERIALIZED (SELECT r, i, CAST(floor(256 * CAST(e[i] AS DOUBLE)) AS BIGINT) AS x FROM (SELECT r, e, unnest(range(1, 65)) AS i FROM whole)),
c0 AS MATERIALIZED (SELECT c, i, x FROM (SELECT r, row_number() OVER (ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR))) - 1 AS c FROM whole WHERE vec_id IS NOT NULL QUALIFY c < {k}) JOIN p USING (r))"""
    steps = []
    for n in range(rounds + 1):
        steps.append(f"""a{n} AS MATERIALIZED (SELECT r, c, d FROM (SELECT p.r, c.c, CAST(sum((p.x - c.x) * (p.x - c.x)) AS BIGINT) AS d FROM p JOIN c{n} c ON p.i = c.i GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)""")
        if n < rounds:
            steps.append(f"""c{n + 1} AS MATERIALIZED (SELECT c, i, coalesce(m.x, o.x) AS x FROM c{n} o LEFT JOIN (SELECT c, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS x FROM (SELECT a.c, p.i, CAST(sum(p.x) AS BIGINT) AS s, count(*) AS n FROM a{n} a JOIN p USING (r) GROUP BY ALL)) m USING (c, i))""")
    end = f"""SELECT vec_id, CAST(c AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM a{rounds} JOIN whole USING (r) JOIN (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY c) USING (c)"""
    return ",\n".join([start, *steps]) + "\n" + end


TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEARCH = f"""WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}') AS t FROM documents WHERE text IS NOT NULL),
d AS MATERIALIZED (SELECT r, doc_id, CAST(len(t) AS BIGINT) AS n, t FROM t WHERE len(t) > 0),
s AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM d),
f AS MATERIALIZED (SELECT r, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(t) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM f GROUP BY 1), s),
q AS (SELECT b, item_id, term, CAST(count(*) AS BIGINT) AS c FROM (SELECT b, item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM (SELECT row_number() OVER () AS b, item_id, text FROM benchmark)) GROUP BY ALL),
g AS (SELECT b, item_id, doc_id, r, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * nn) // ll)))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN f USING (term) JOIN d USING (r), s GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY b ORDER BY score DESC, doc_id NULLS LAST) AS INT) AS rank, doc_id, score FROM g WHERE score > 0 QUALIFY rank <= 10"""
