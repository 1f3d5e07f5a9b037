"""DuckDB SQL for the further queries. Sampled draws, trained models and decompositions have none."""

from __future__ import annotations

from . import oracle as o

_REGIONS = "SELECT c_custkey AS iid, 'c:' || CAST(c_custkey AS VARCHAR) AS source, 'r:' || CAST(n_regionkey AS VARCHAR) AS target, 1 AS label FROM customer JOIN nation ON c_nationkey = n_nationkey"
_TWINS = "SELECT c_custkey AS iid, 'c:' || CAST(c_custkey AS VARCHAR) AS source, 'c:' || CAST(c_custkey + 1 AS VARCHAR) AS target, 1 AS label FROM customer"
_KEYS = o._kg(["in_nation"]) + " UNION ALL SELECT 'c:' || CAST(c_custkey AS VARCHAR), 'key', CAST(c_nationkey AS VARCHAR) FROM customer"
_NAMED = "SELECT c_custkey AS iid, c_name AS source, n_name AS target, 1 AS label FROM customer JOIN nation ON c_nationkey = n_nationkey"
_ALIASED = o._kg(["in_nation"]) + " UNION ALL SELECT c_name, '@ALIAS@', 'c:' || CAST(c_custkey AS VARCHAR) FROM customer UNION ALL SELECT n_name, '@ALIAS@', 'n:' || CAST(n_nationkey AS VARCHAR) FROM nation"


def _over(kg: str, inst: str, steps: int) -> str:
    """The tables of oracle._sub over another graph and other instances, without a cap and nothing held out."""
    met = ", sub AS (SELECT iid, start, node, path FROM a UNION SELECT iid, start, node, path FROM b UNION SELECT a.iid, a.start, b.start, a.path || substr(b.back, 2) FROM a JOIN b ON a.iid = b.iid AND a.node = b.node)"
    sides = o._side("a", "source", False, steps) + o._side("b", "target", False, steps)
    joins = ", joins AS (SELECT DISTINCT s.iid, s.path FROM sub s JOIN inst i ON s.iid = i.iid WHERE s.start = i.source AND s.node = i.target)"
    return f"WITH kg AS ({kg}), adj0 AS ({o._ADJ}), adj AS (SELECT n, l, m FROM adj0), inst AS ({inst}){sides}{met}{joins} "


_SIDES = "FROM (SELECT s.iid, s.path, s.node FROM sub s JOIN inst i ON s.iid = i.iid WHERE s.start = i.source) x JOIN (SELECT s.iid, s.path, s.node FROM sub s JOIN inst i ON s.iid = i.iid WHERE s.start = i.target) y ON x.iid = y.iid AND x.path = y.path"


def _edges_rank(steps: int) -> str:
    q = f"WITH kg AS ({o._kg()}), adj0 AS ({o._ADJ}), dg AS (SELECT n, count(*) AS d FROM adj0 GROUP BY n), st AS (SELECT n, m, count(*) AS k FROM adj0 GROUP BY n, m), w0 AS (SELECT DISTINCT n AS start, n AS node, {o.UNIT} AS w FROM ({o.NATIONS}) z)"
    for i in range(steps):
        q += f", m{i} AS (SELECT x.start, st.m AS node, CAST(sum({o._down('CAST(x.w AS DOUBLE) * CAST(0.85 AS DOUBLE) * st.k / dg.d')}) AS BIGINT) AS w FROM w{i} x JOIN st ON x.node = st.n JOIN dg ON dg.n = st.n GROUP BY x.start, st.m)"
        q += f", w{i + 1} AS (SELECT start, node, CAST(sum(w) AS BIGINT) AS w FROM (SELECT * FROM m{i} UNION ALL SELECT w0.start, w0.start, {o.UNIT} - coalesce(g.w, 0) FROM w0 LEFT JOIN (SELECT start, CAST(sum(w) AS BIGINT) AS w FROM m{i} GROUP BY start) g ON w0.start = g.start) z GROUP BY start, node)"
    every = " UNION ALL ".join(f"SELECT * FROM m{i}" for i in range(steps))
    return q + f" SELECT start, node, {o._part('share')} * 250 AS visits FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY share DESC, node) AS rank FROM (SELECT start, node, CAST(sum(w) AS BIGINT) AS share FROM ({every}) z WHERE start <> node GROUP BY start, node) y) x WHERE rank <= 100"


_FOLLOWED = [["_placed_by", "from_supp"], ["_placed_by", "from_supp", "supp_nation"], ["in_nation"]]


def _follow_all() -> str:
    q = o._graph(["placed_by", "from_supp", "supp_nation", "in_nation"]).rstrip() + f", w0 AS (SELECT DISTINCT t AS start, t AS node, {o.UNIT} AS w FROM kg WHERE r = 'placed_by'), d AS (SELECT n, l, count(*) AS d FROM adj GROUP BY n, l), st AS (SELECT n, l, m, count(*) AS k FROM adj GROUP BY n, l, m)"
    for j, path in enumerate(_FOLLOWED):
        for i, label in enumerate(path):
            before = f"x{j}_{i}" if i else "w0"
            q += f", x{j}_{i + 1} AS (SELECT x.start, a.m AS node, CAST(sum({o._down('CAST(x.w AS DOUBLE) * a.k / d.d')}) AS BIGINT) AS w FROM {before} x JOIN st a ON a.n = x.node AND a.l = '{label}' JOIN d ON d.n = a.n AND d.l = a.l GROUP BY x.start, a.m)"
    every = " UNION ALL ".join(f"SELECT '-{'-'.join(p)}-' AS path, start, node AS target, CAST(w AS DOUBLE) / CAST(CAST(sum(w) OVER (PARTITION BY start) AS BIGINT) AS DOUBLE) AS p FROM x{j}_{len(p)}" for j, p in enumerate(_FOLLOWED))
    return q + f", followed AS ({every}) "


_FOUND = (
    f"WITH kg AS ({o._kg(['in_nation', 'in_region', 'supp_nation'])}), adj0 AS ({o._ADJ}), st AS (SELECT n, l, m, count(*) AS k FROM adj0 GROUP BY n, l, m), d AS (SELECT n, count(*) AS d FROM adj0 GROUP BY n), inst AS ({_REGIONS}), "
    "f1 AS (SELECT iid, source, st.m AS node, '-' || l || '-' AS path, CAST(k AS DOUBLE) / d AS w FROM inst JOIN st ON st.n = source JOIN d ON d.n = st.n WHERE st.m <> source), "
    "f2 AS (SELECT iid, path || l || '-' AS path, w * k / d AS w FROM f1 JOIN st ON st.n = f1.node JOIN d ON d.n = st.n WHERE st.m <> f1.node AND st.m <> f1.source), "
    "m1 AS (SELECT iid, sum(w) AS m FROM f1 GROUP BY iid) "
    "SELECT path, round(CAST(sum(v) AS DOUBLE), 6) AS visits FROM (SELECT path, 100 * w * (2 - m) AS v FROM f1 JOIN m1 ON f1.iid = m1.iid UNION ALL SELECT path, 100 * w FROM f2) z GROUP BY path"
)


def _similar(path: list[str]) -> str:
    q = f"WITH kg AS ({o._kg(['in_nation', 'supp_nation', 'in_region', 'from_supp'])}), adj AS (SELECT n, l, m FROM ({o._ADJ}) z), vec(r, x, y) AS (VALUES ('in_nation', 1.0, 0.0), ('supp_nation', 0.8, 0.6), ('in_region', 0.0, 1.0), ('from_supp', -0.6, 0.8)), st AS (SELECT n, l, m, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY n, l) AS q FROM adj GROUP BY n, l, m), w0 AS (SELECT 'n:' || CAST(n_nationkey AS VARCHAR) AS start, 'n:' || CAST(n_nationkey AS VARCHAR) AS node, CAST(1 AS DOUBLE) AS w FROM nation)"
    for i, label in enumerate(path):
        back = label.startswith("_")
        q += f", e{i} AS (SELECT h.n, h.l, exp(3.0 * CAST(a.x * b.x + a.y * b.y AS DOUBLE)) AS e FROM (SELECT DISTINCT n, l FROM adj WHERE {'' if back else 'NOT '}starts_with(l, '_')) h JOIN vec a ON a.r = ltrim(h.l, '_') JOIN vec b ON b.r = '{label.lstrip('_')}')"
        q += f", q{i} AS (SELECT n, l, CASE WHEN count(*) OVER (PARTITION BY n) = 1 AND l = '{label}' THEN 1.0 ELSE e / (sum(e) OVER (PARTITION BY n) + 0.25) END AS q FROM e{i})"
        q += f", w{i + 1} AS (SELECT x.start, st.m AS node, sum(x.w * st.q * q.q) AS w FROM w{i} x JOIN st ON st.n = x.node JOIN q{i} q ON q.n = st.n AND q.l = st.l GROUP BY x.start, st.m)"
    return q + f" SELECT start, target, {o._round('p')} FROM (SELECT start, node AS target, w / sum(w) OVER (PARTITION BY start) AS p FROM w{len(path)}) z"


ORACLE_SQL = {
    "feat_mediator": o._count("SELECT iid, 'CONNECTED_BY_MEDIATOR' AS feature FROM joins WHERE length(path) - length(replace(path, '-', '')) = 3", _over(o._kg(["in_nation", "in_region"]), _REGIONS, 1)),
    "feat_catcomp": o._count(f"SELECT x.iid, 'CATCOMP:' || x.path || ':' || x.node || ':' || y.node AS feature {_SIDES}", _over(_KEYS, _TWINS, 1)),
    "feat_numcomp": o._count(f"SELECT x.iid, 'NUMCOMP:' || x.path || ':' || CASE WHEN x.node = y.node THEN '-Infinity' ELSE CAST(round(log10(abs(CAST(x.node AS DOUBLE) - CAST(y.node AS DOUBLE))), 2) AS VARCHAR) END AS feature {_SIDES} WHERE x.path = '-key-'", _over(_KEYS, _TWINS, 1)),
    "feat_anyrel_alias": o._count("SELECT iid, 'ANYREL:-' || array_to_string(list_concat(list_concat(p[1:i-1], ['@ANY_REL@']), p[i+1:]), '-') || '-' AS feature FROM (SELECT iid, p, unnest(range(2, len(p))) AS i FROM (SELECT iid, string_split(trim(path, '-'), '-') AS p FROM joins) u WHERE len(p) > 2 AND ltrim(p[1], '_') = '@ALIAS@' AND ltrim(p[-1], '_') = '@ALIAS@') v", _over(_ALIASED, _NAMED, 2)),
    "feat_with_bias": o._count("SELECT iid, path AS feature FROM joins UNION ALL SELECT iid, 'bias' FROM joins", o._SUB),
    "kg_aliases_only": "SELECT 'p:' || CAST(p_partkey AS VARCHAR) AS s, '@ALIAS@' AS r, p_type AS t FROM part",
    "allowed_targets": "SELECT 'n:' || CAST(n_nationkey AS VARCHAR) AS n FROM nation WHERE n_regionkey = 1",
    "ppr_topk": f"SELECT start, node, visits, rank FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY visits DESC, node) AS rank FROM ({o._ppr(3)}) a) b WHERE rank <= 5",
    "ppr_edges": _edges_rank(3),
    "path_find_expected": _FOUND,
    "path_follow_all": _follow_all() + "SELECT path, start, target, p FROM followed",
    "path_follow_similar": _similar(["_in_nation", "in_nation"]),
    "row_policy_all_targets": _follow_all() + "SELECT path, start, target, p FROM followed WHERE target IN (SELECT target FROM inst)",
    "row_policy_paired_targets": _follow_all() + "SELECT path, start, target, p FROM followed f WHERE EXISTS (SELECT 1 FROM inst i WHERE i.source = f.start AND i.target = f.target)",
    "sim_exact": "WITH e AS (SELECT CAST(label AS VARCHAR) AS r, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding) AS x FROM embeddings WHERE label IS NOT NULL), m AS (SELECT r, i, avg(CAST(x AS DOUBLE)) AS x FROM e GROUP BY r, i), u AS (SELECT r, i, x / sqrt(sum(x * x) OVER (PARTITION BY r)) AS x FROM m) SELECT r1, r2, round(w, 6) AS weight FROM (SELECT a.r AS r1, b.r AS r2, sum(a.x * b.x) AS w FROM u a JOIN u b ON a.i = b.i AND a.r <> b.r GROUP BY a.r, b.r) z WHERE w > 0 AND w < 2",
    "metric_per_query": o._PRED + f"SELECT relation, source, {o._round('ap', 'rr')} FROM each",
    "metric_permutation_exact": o._PRED + ", d AS (SELECT row_number() OVER (ORDER BY relation) - 1 AS i, round(CAST(ap AS DOUBLE), 6) - round(CAST(query_map AS DOUBLE), 6) AS d FROM per), f AS (SELECT unnest(range(0, (SELECT CAST(1 AS BIGINT) << count(*) FROM d))) AS id), x AS (SELECT id, abs(sum(CASE WHEN (id >> i) & 1 = 1 THEN -d ELSE d END)) AS x FROM f CROSS JOIN d GROUP BY id) SELECT round(avg(CASE WHEN x >= (SELECT abs(sum(d)) FROM d) - 1e-12 THEN 1.0 ELSE 0.0 END), 6) AS p FROM x",
    "related_nodes_lexicalised": "SELECT 's:' || CAST(s_suppkey AS VARCHAR) AS start, 'r:' || CAST(n_regionkey AS VARCHAR) AS node FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_nationkey = 3",
    "related_nodes_mediator": "SELECT 'c:' || CAST(c_custkey AS VARCHAR) AS start, 'r:' || CAST(n_regionkey AS VARCHAR) AS node FROM customer JOIN nation ON c_nationkey = n_nationkey",
}
