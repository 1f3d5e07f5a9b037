"""DuckDB SQL for the operators that SQL can express: near-duplicate vectors and documents, repeated passages, secret scans."""

from __future__ import annotations

from .flat_graph import LIMIT
from .secrets import COPIED_OWNERS, COPIED_REPOSITORIES, KINDS
from .setsketch import OF, PER
from .suffixes import LEAST

#: Words of every text, as the operators cut them.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
#: The smallest node that links reach, from edges (a, b) of both directions.
_REACHED = "reach AS (SELECT DISTINCT a AS node, a AS low FROM edges UNION SELECT e.b, r.low FROM reach r JOIN edges e ON e.a = r.node WHERE r.low < e.b), groups AS (SELECT node, min(low) AS component FROM reach GROUP BY node)"

VECTORS = f"""WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
fine AS (SELECT vec_id, label, x FROM v WHERE len(x) > 0 AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(x, lambda y: y <> 0)) > 0),
edges AS (SELECT p.vec_id AS a, q.vec_id AS b FROM fine p JOIN fine q ON p.label = q.label AND p.vec_id <> q.vec_id AND len(p.x) = len(q.x) AND list_cosine_similarity(p.x, q.x) >= {LIMIT}),
{_REACHED}, n AS (SELECT a, count(*) AS n FROM edges GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, coalesce(component, vec_id) AS component_id, coalesce(component, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN groups ON node = vec_id LEFT JOIN n ON n.a = vec_id"""

DOCUMENTS = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: hash(w[i:i+4]))) WHEN len(w) > 0 THEN [hash(w)] ELSE [] END AS s FROM w),
each AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
near AS (SELECT p.doc_id AS a, q.doc_id AS b FROM each p JOIN each q ON p.x = q.x AND p.doc_id <> q.doc_id AND least(p.n, q.n) * {OF} >= greatest(p.n, q.n) * {PER} GROUP BY p.doc_id, q.doc_id, p.n, q.n HAVING {OF} * count(*) >= {PER} * (p.n + q.n - count(*))),
edges AS (SELECT a, b FROM near), {_REACHED}
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(component, s.doc_id) AS component_id, coalesce(component, s.doc_id) = s.doc_id AS kept FROM s LEFT JOIN groups ON node = s.doc_id"""

PASSAGES = f"""WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL),
win AS (SELECT doc_id, i - 1 AS s, hash(w[i:i+{LEAST - 1}]) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - {LEAST - 2})) AS i FROM w WHERE len(w) >= {LEAST}) z),
rep AS (SELECT doc_id, s, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) = 1 AS first FROM win QUALIFY count(*) OVER (PARTITION BY h) > 1),
word AS (SELECT doc_id, p, max(first) AS first FROM (SELECT doc_id, first, unnest(range(s, s + {LEAST})) AS p FROM rep) z GROUP BY doc_id, p),
run AS (SELECT doc_id, first, p, p - row_number() OVER (PARTITION BY doc_id, first ORDER BY p) AS g FROM word)
SELECT doc_id, CAST(min(p) AS INTEGER) AS start_word, CAST(count(*) AS INTEGER) AS n_words, first FROM run GROUP BY doc_id, first, g"""


def _secrets() -> str:
    def found(place: int) -> str:
        kind, pattern, group, least = KINDS[place]
        # A run that is long enough is found at once; assign keeps its short matches until they are dropped, as they hide others.
        pattern = {"hex": f"[0-9a-f]{{{least},}}", "access": f"AKIA[A-Z0-9]{{{least - 4},}}"}.get(kind, pattern).replace("'", "''")
        return f"SELECT rid, {place} AS place, '{kind}' AS kind, {least} AS least, regexp_extract_all(t, '{pattern}', 0) AS ms, regexp_extract_all(t, '{pattern}', {group}) AS vs, string_split_regex(t, '{pattern}') AS gs FROM d"

    looks = "regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND len(list_distinct(string_split(lower(v), ''))) >= 7 AND NOT regexp_matches(lower(v), 'example|sample|dummy|changeme|placeholder|xxxx|0123456|abcdef')"
    line = "coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place), '')"
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(CAST(source AS VARCHAR), chr(0)) AS owner, concat_ws('/', source, lang) AS repo FROM documents),
m AS ({" UNION ALL ".join(found(i) for i in range(len(KINDS)))}),
x AS (SELECT rid, place, kind, least, ms, vs, gs, unnest(range(1, len(ms) + 1)) AS i FROM m WHERE len(ms) > 0),
y AS (SELECT rid, place, kind, vs[i] AS v, CAST(list_sum(list_transform(gs[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda g: length(g))), 0) AS BIGINT) AS start, length(ms[i]) AS n FROM x WHERE length(vs[i]) >= least),
z AS (SELECT rid, place, kind, v, start, start + n AS stop, {looks} AS looks FROM y),
c AS (SELECT * FROM z WHERE place < 3 OR (looks AND NOT EXISTS (SELECT 1 FROM z b WHERE b.rid = z.rid AND b.place < 3 AND b.start < z.stop AND z.start < b.stop))),
held AS (SELECT v, count(DISTINCT owner) AS owners, count(DISTINCT (owner, repo)) AS repos FROM c JOIN d USING (rid) GROUP BY v),
j AS (SELECT c.*, looks AND owners < {COPIED_OWNERS} AND repos < {COPIED_REPOSITORIES} AS live FROM c JOIN held USING (v)),
out AS (SELECT rid, count(*) FILTER (place = 0) AS n_assign, count(*) FILTER (place = 1) AS n_access, count(*) FILTER (place = 2) AS n_hex, count(*) FILTER (live) AS n_live, {line.replace("ORDER BY start, place)", "ORDER BY start, place) FILTER (place < 3)")} AS base, {line} AS spans FROM j WHERE place < 3 OR live GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(n_live, 0) AS n_live, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN out USING (rid)"""


ORACLE_SQL = {"op2_flat_graph": VECTORS, "op3_suffix_dedup": PASSAGES, "op4_setsketch": DOCUMENTS, "op10_secrets": _secrets()}
