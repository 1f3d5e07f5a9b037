"""DuckDB SQL for the queries of the catalogue."""

from __future__ import annotations

_PARTS = [
    ("customer", "c", "c_custkey", "in_nation", "n", "c_nationkey"),
    ("supplier", "s", "s_suppkey", "supp_nation", "n", "s_nationkey"),
    ("nation", "n", "n_nationkey", "in_region", "r", "n_regionkey"),
    ("orders", "o", "o_orderkey", "placed_by", "c", "o_custkey"),
    ("lineitem", "o", "l_orderkey", "has_part", "p", "l_partkey"),
    ("lineitem", "o", "l_orderkey", "from_supp", "s", "l_suppkey"),
    ("part", "p", "p_partkey", "brand", "b", "p_brand"),
]


def _kg(names=None) -> str:
    return " UNION ALL ".join(f"SELECT '{a}:' || CAST({x} AS VARCHAR) AS s, '{r}' AS r, '{b}:' || CAST({y} AS VARCHAR) AS t FROM {tab}" for tab, a, x, r, b, y in _PARTS if not names or r in names)


_ADJ = "SELECT s AS n, r AS l, t AS m, r FROM kg UNION ALL SELECT t, '_' || r, s, r FROM kg"
INST = """SELECT c_custkey * 2 AS iid, 'c:' || CAST(c_custkey AS VARCHAR) AS source, 'n:' || CAST(c_nationkey AS VARCHAR) AS target, 1 AS label FROM customer
UNION ALL SELECT c_custkey * 2 + 1, 'c:' || CAST(c_custkey AS VARCHAR), 'n:' || CAST((c_nationkey + 1) % 25 AS VARCHAR), -1 FROM customer"""


def _graph(names=None, cap: bool = False, extra: str = "") -> str:
    adj = "SELECT n, l, m FROM adj0 a JOIN (SELECT n AS n2, r AS r2 FROM adj0 GROUP BY n, r HAVING count(*) <= 100) f ON a.n = f.n2 AND a.r = f.r2" if cap else "SELECT n, l, m FROM adj0"
    return f"WITH kg AS ({_kg(names)}), adj0 AS ({_ADJ}), adj AS ({adj}), inst AS ({INST}){extra} "


_FLIP = "CASE WHEN l LIKE '\\_%' ESCAPE '\\' THEN substr(l, 2) ELSE '_' || l END"


def _side(name: str, start: str, held: bool, steps: int = 2) -> str:
    skip = "AND NOT (a.l IN ('in_nation', '_in_nation') AND ((a.n = x.source AND a.m = x.target) OR (a.n = x.target AND a.m = x.source)))" if held else ""
    out = f", {name}1 AS (SELECT DISTINCT iid, source, target, {start} AS start, a.m AS node, '-' || l || '-' AS path, '-' || {_FLIP} || '-' AS back FROM inst x JOIN adj a ON a.n = x.{start} {skip})"
    if steps == 2:
        out += f", {name}2 AS (SELECT DISTINCT iid, source, target, start, a.m AS node, path || l || '-' AS path, '-' || {_FLIP} || back AS back FROM {name}1 x JOIN adj a ON a.n = x.node {skip})"
    return out + f", {name} AS (SELECT * FROM {name}1" + (f" UNION ALL SELECT * FROM {name}2" if steps == 2 else "") + ")"


def _sub(names=None, held: bool = True, steps: int = 2) -> str:
    met = ", sub AS (SELECT iid, start, node, path FROM a UNION SELECT iid, start, node, path FROM b UNION SELECT a.iid, a.start, b.start, a.path || substr(b.back, 2) FROM a JOIN b ON a.iid = b.iid AND a.node = b.node)"
    return _graph(names, True, _side("a", "source", held, steps) + _side("b", "target", held, steps) + met + ", joins AS (SELECT DISTINCT s.iid, s.path FROM sub s JOIN inst i ON s.iid = i.iid WHERE s.start = i.source AND s.node = i.target)")


def _count(features: str, sub: str) -> str:
    """features: a select of (iid, feature)."""
    return sub + f"SELECT feature, count(*) AS n FROM (SELECT DISTINCT iid, feature FROM ({features}) q) z GROUP BY feature"


_SUB = _sub()
_NODE = _graph(None, True, _side("a", "source", False) + ", sub AS (SELECT DISTINCT iid, start, node, path FROM a)")
_END = "SELECT s.iid, CASE WHEN s.start = i.source THEN 'SOURCE:' ELSE 'TARGET:' END || s.path || ':' || s.node AS feature FROM sub s JOIN inst i ON s.iid = i.iid WHERE s.start = i.source OR s.start = i.target"
_BARE = "SELECT s.iid, CASE WHEN s.start = i.source THEN 'SOURCE:' ELSE 'TARGET:' END || s.path AS feature FROM sub s JOIN inst i ON s.iid = i.iid WHERE s.start = i.source OR s.start = i.target"
_PRED = """WITH pred AS (SELECT o_orderpriority AS relation, 'c:' || CAST(o_custkey AS VARCHAR) AS source, 's:' || CAST(l_suppkey AS VARCHAR) AS target, sum(l_quantity) - 20 AS score,
max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS hit FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3), kept AS (SELECT * FROM pred WHERE score > 0),
pos AS (SELECT relation, source, target FROM pred WHERE hit = 1),
r1 AS (SELECT relation, hit, row_number() OVER w AS rk, sum(hit) OVER w AS hits FROM kept WINDOW w AS (PARTITION BY relation ORDER BY score DESC, source, target ROWS UNBOUNDED PRECEDING)),
r2 AS (SELECT relation, source, hit, row_number() OVER w AS rk, sum(hit) OVER w AS hits FROM kept WINDOW w AS (PARTITION BY relation, source ORDER BY score DESC, target ROWS UNBOUNDED PRECEDING)),
whole AS (SELECT n.relation, coalesce(sp / n, 0.0) AS ap, coalesce(1.0 / f, 0.0) AS rr FROM (SELECT relation, count(*) AS n FROM pos GROUP BY relation) n LEFT JOIN (SELECT relation, sum(CAST(hits AS DOUBLE) / rk) AS sp, min(rk) AS f FROM r1 WHERE hit = 1 GROUP BY relation) g ON n.relation = g.relation),
each AS (SELECT n.relation, n.source, coalesce(sp / n, 0.0) AS ap, coalesce(1.0 / f, 0.0) AS rr, h.source IS NOT NULL AS has FROM (SELECT relation, source, count(*) AS n FROM pos GROUP BY relation, source) n
LEFT JOIN (SELECT relation, source, sum(CAST(hits AS DOUBLE) / rk) AS sp, min(rk) AS f FROM r2 WHERE hit = 1 GROUP BY relation, source) g ON n.relation = g.relation AND n.source = g.source
LEFT JOIN (SELECT DISTINCT relation, source FROM kept) h ON n.relation = h.relation AND n.source = h.source),
per AS (SELECT w.relation, w.ap, w.rr, q.* EXCLUDE (relation) FROM whole w JOIN (SELECT relation, avg(ap) AS query_map, avg(rr) AS query_mrr, coalesce(avg(CASE WHEN has THEN ap END), -1.0) AS predicted_map, coalesce(avg(CASE WHEN has THEN rr END), -1.0) AS predicted_mrr, avg(CASE WHEN has THEN 0.0 ELSE 1.0 END) AS no_prediction FROM each GROUP BY relation) q ON w.relation = q.relation) """
_MAP = "(VALUES ('in_nation', 'located'), ('supp_nation', 'located'), ('supp_nation', 'supply'), ('from_supp', 'supply')) AS c(r, cluster)"
_SIM = "('in_nation', 'supp_nation', 0.9), ('supp_nation', 'in_nation', 0.9), ('in_region', 'in_nation', 0.7), ('placed_by', 'in_region', 0.2)"
_KG = f"WITH kg AS ({_kg()}) "
_round = lambda *c: ", ".join(f"round(CAST({x} AS DOUBLE), 6) AS {x}" for x in c)


#: Shares of walks are whole numbers of this, rounded down at each step.
UNIT = "CAST(100000000000000000 AS BIGINT)"
_down = lambda x: f"CAST(floor({x}) AS BIGINT)"
_part = lambda x: f"CAST({x} AS DOUBLE) / CAST({UNIT} AS DOUBLE)"


def _shares(name: str, starts: str, steps: int) -> str:
    """Tables up to name (start, node, share) of walks from starts (a select of n) over nb and d."""
    q = f", {name}w0 AS (SELECT DISTINCT n AS start, n AS node, {UNIT} AS w FROM ({starts}) z)"
    for i in range(steps):
        q += f", {name}m{i} AS (SELECT x.start, nb.m AS node, CAST(sum({_down('CAST(x.w AS DOUBLE) / d.d')}) AS BIGINT) AS w FROM {name}w{i} x JOIN nb ON x.node = nb.n JOIN d ON d.n = nb.n GROUP BY x.start, nb.m)"
        back = _down("CAST(CAST(sum(w) AS BIGINT) AS DOUBLE) * CAST(0.15 AS DOUBLE)")
        q += f", {name}w{i + 1} AS (SELECT start, node, CAST(sum(w) AS BIGINT) AS w FROM (SELECT start, node, {_down('CAST(w AS DOUBLE) * CAST(0.85 AS DOUBLE)')} AS w FROM {name}m{i} UNION ALL SELECT start, start, {back} FROM {name}m{i} GROUP BY start) z GROUP BY start, node)"
    every = " UNION ALL ".join(f"SELECT * FROM {name}m{i}" for i in range(steps))
    return q + f", {name} AS (SELECT start, node, CAST(sum(w) AS BIGINT) AS share FROM ({every}) z WHERE start <> node GROUP BY start, node)"


def _walked(names=None) -> str:
    return f"WITH kg AS ({_kg(names)}), adj0 AS ({_ADJ}), nb AS (SELECT DISTINCT n, m FROM adj0), d AS (SELECT n, count(*) AS d FROM nb GROUP BY n)"


NATIONS = "SELECT 'n:' || CAST(n_nationkey AS VARCHAR) AS n FROM nation"


def _ppr(steps: int) -> str:
    return _walked() + _shares("rank", NATIONS, steps) + f" SELECT start, node, {_part('share')} * 250 AS visits FROM rank"


def _drawn(end: str, steps: int, allowed: str) -> str:
    """Tables of the most visited nodes from one end of the positives, up to running totals, and of what each attempt draws there."""
    q = _shares(f"{end}all", f"SELECT {end} AS n FROM pos", steps)
    q += f", {end}top AS (SELECT * FROM (SELECT start, node, share, row_number() OVER (PARTITION BY start ORDER BY share DESC, node) AS rank FROM {end}all WHERE node IN ({allowed})) z WHERE rank <= 100)"
    q += f", {end}run AS (SELECT start, node, CAST(sum(share) OVER w AS BIGINT) AS hi, CAST(sum(share) OVER w AS BIGINT) - share AS lo FROM {end}top WINDOW w AS (PARTITION BY start ORDER BY rank ROWS UNBOUNDED PRECEDING))"
    q += f", {end}total AS (SELECT start, CAST(sum(share) AS BIGINT) AS total FROM {end}top GROUP BY start)"
    u = f"CAST(CAST('0x' || substr(md5(source || '|' || target || '|' || CAST(attempt AS VARCHAR) || '|{end}|1'), 1, 13) AS BIGINT) AS DOUBLE) / CAST(4503599627370496 AS DOUBLE)"
    q += f", {end}at AS (SELECT a.source, a.target, a.attempt, {_down(f'{u} * CAST(1.25 AS DOUBLE) * CAST(t.total AS DOUBLE)')} AS v FROM tries a LEFT JOIN {end}total t ON t.start = a.{end})"
    return q + f", {end}new AS (SELECT a.source, a.target, a.attempt, coalesce(r.node, a.{end}) AS node FROM {end}at a LEFT JOIN {end}run r ON r.start = a.{end} AND a.v >= r.lo AND a.v < r.hi)"


def _negatives(positives: str, steps: int = 2, ratio: int = 3, known: str = "SELECT source, target FROM pos") -> str:
    """Tables up to neg (source, target) of pairs drawn for the positives over customers, nations and regions."""
    q = _walked(["in_nation", "in_region"]) + f", inst AS ({INST}), pos AS ({positives}), tries AS (SELECT source, target, unnest(range({10 * ratio})) AS attempt FROM pos)"
    q += _drawn("source", steps, "SELECT source FROM inst") + _drawn("target", steps, "SELECT target FROM inst")
    q += ", every AS (SELECT s.source, s.target, s.node AS a, t.node AS b, min(s.attempt) AS attempt FROM sourcenew s JOIN targetnew t ON s.source = t.source AND s.target = t.target AND s.attempt = t.attempt GROUP BY 1, 2, 3, 4)"
    q += f", fine AS (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY attempt) AS k FROM every WHERE NOT EXISTS (SELECT 1 FROM ({known}) q WHERE q.source = a AND q.target = b))"
    return q + f", neg AS (SELECT DISTINCT a AS source, b AS target FROM fine WHERE k <= {ratio}) "


def _follow(path: list[str]) -> str:
    q = _graph() + ""
    q = q.rstrip() + f", w0 AS (SELECT DISTINCT t AS start, t AS node, {UNIT} AS w FROM kg WHERE r = 'placed_by'), d AS (SELECT n, l, count(*) AS d FROM adj GROUP BY n, l), st AS (SELECT n, l, m, count(*) AS k FROM adj GROUP BY n, l, m)"
    for i, l in enumerate(path):
        q += f", w{i + 1} AS (SELECT x.start, a.m AS node, CAST(sum({_down('CAST(x.w AS DOUBLE) * a.k / d.d')}) AS BIGINT) AS w FROM w{i} x JOIN st a ON a.n = x.node AND a.l = '{l}' JOIN d ON d.n = a.n AND d.l = a.l GROUP BY x.start, a.m)"
    return q + f" SELECT start, node AS target, CAST(w AS DOUBLE) / CAST(CAST(sum(w) OVER (PARTITION BY start) AS BIGINT) AS DOUBLE) AS p FROM w{len(path)}"


_ANY = "SELECT iid, 'ANYREL:-' || array_to_string(list_concat(list_concat(p[1:i-1], ['@ANY_REL@']), p[i+1:]), '-') || '-' AS feature FROM (SELECT iid, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT iid, string_split(trim(path, '-'), '-') AS p FROM joins) u) v"

ORACLE_SQL = {
    "kg_triples": _KG + "SELECT s, r, t FROM kg",
    "kg_dedup": _KG + "SELECT DISTINCT s, r, t FROM kg",
    "kg_degree_by_relation": _KG + "SELECT n, r, CAST(sum(o) AS BIGINT) AS n_out, CAST(sum(i) AS BIGINT) AS n_in, count(*) AS n_both FROM (SELECT s AS n, r, CAST(1 AS BIGINT) AS o, CAST(0 AS BIGINT) AS i FROM kg UNION ALL SELECT t, r, 0, 1 FROM kg) x GROUP BY n, r",
    "kg_adjacency_both_ways": _KG + "SELECT s AS n, r AS l, t AS m FROM kg UNION ALL SELECT t, '_' || r, s FROM kg",
    "kg_connected_nodes": _KG + "SELECT s AS n, t AS m FROM kg UNION SELECT t, s FROM kg",
    "kg_dictionary_ids": f"WITH kg AS ({_kg()}), p AS (SELECT s, t, row_number() OVER (ORDER BY s, r, t) AS pos FROM kg), f AS (SELECT name, min(place) AS place FROM (SELECT s AS name, pos * 2 AS place FROM p UNION ALL SELECT t, pos * 2 + 1 FROM p) x GROUP BY name) SELECT row_number() OVER (ORDER BY place) AS id, name FROM f",
    "kg_relation_prefix": _KG + "SELECT s, '1-' || r AS r, t FROM kg",
    "kg_replace_relation": _KG + "SELECT s, 'related' AS r, t FROM kg",
    "kg_cluster_expand": _KG + f"SELECT s, coalesce(c.cluster, kg.r) AS r, t FROM kg LEFT JOIN {_MAP} ON kg.r = c.r",
    "kg_cluster_keep_original": _KG + f"SELECT s, r, t FROM kg UNION ALL SELECT s, c.cluster, t FROM kg JOIN {_MAP} ON kg.r = c.r",
    "kg_alias_edges": "SELECT 'p:' || CAST(p_partkey AS VARCHAR) AS s, '@ALIAS@' AS r, p_type AS t FROM part",
    "kg_relation_matrix_sizes": _KG + "SELECT r, count(*) AS entries, count(DISTINCT s || '|' || t) AS cells FROM kg GROUP BY r",
    "kg_instance_graph_string": _KG + "SELECT s AS k, string_agg(s || '^,^' || r || '^,^' || t, ' ### ' ORDER BY s || '^,^' || r || '^,^' || t) AS graph FROM kg WHERE r IN ('has_part', 'from_supp') GROUP BY s",
    "kg_instance_graph_parse": _KG + "SELECT s AS k, s, r, t FROM kg WHERE r IN ('has_part', 'from_supp')",
    "kg_fan_out_cap": _graph(None, True) + "SELECT n, l, m FROM adj",
    "split_prefix_by_label": f"SELECT iid, source, target, label, CASE WHEN pos <= floor(0.8 * n) THEN 'training' ELSE 'testing' END AS fold FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY iid) AS pos, count(*) OVER (PARTITION BY label) AS n FROM ({INST}) i) x",
    "split_prefix": f"SELECT iid, source, target, label, CASE WHEN pos <= floor(0.75 * n) THEN 'training' ELSE 'testing' END AS fold FROM (SELECT *, row_number() OVER (ORDER BY iid) AS pos, count(*) OVER () AS n FROM ({INST}) i) x",
    "bfs_pair_paths": _sub(None, False) + "SELECT iid, count(*) AS n_entries, count(DISTINCT path) AS n_paths FROM sub GROUP BY iid",
    "bfs_pair_paths_heldout": _SUB + "SELECT path, count(*) AS n_entries FROM sub GROUP BY path",
    "bfs_node_paths": _NODE + "SELECT path, count(*) AS n_entries FROM sub GROUP BY path",
    "bfs_path_counts": _SUB + "SELECT path, count(DISTINCT iid) AS n_pairs FROM joins GROUP BY path",
    "feat_pra": _count("SELECT iid, path AS feature FROM joins", _SUB),
    "feat_pra_filtered": _count("SELECT iid, path AS feature FROM joins WHERE path LIKE '-\\_placed\\_by-_%' ESCAPE '\\' AND NOT path LIKE '%-\\_supp\\_nation-_%' ESCAPE '\\'", _SUB),
    "feat_one_sided": _count(_BARE, _SUB),
    "feat_one_sided_end": _count(_END, _SUB),
    "feat_bigrams": _count("SELECT iid, 'BIGRAM:' || p[i] || '-' || p[i + 1] AS feature FROM (SELECT iid, p, unnest(range(1, len(p))) AS i FROM (SELECT iid, list_concat(list_concat(['@START@'], string_split(trim(path, '-'), '-')), ['@END@']) AS p FROM joins) u) v", _SUB),
    "feat_anyrel": _count(_ANY, _SUB),
    "feat_vecsim": _count(_ANY.replace("ANYREL:", "VECSIM:") + f" UNION ALL SELECT iid, 'VECSIM:' || path FROM joins UNION ALL SELECT iid, 'VECSIM:-' || array_to_string(list_concat(list_concat(p[1:i-1], [CASE WHEN starts_with(p[i], '_') THEN '_' || r2 ELSE r2 END]), p[i+1:]), '-') || '-' FROM (SELECT iid, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT iid, string_split(trim(path, '-'), '-') AS p FROM joins) u) v JOIN (VALUES {_SIM}) AS q(r1, r2, weight) ON q.r1 = ltrim(p[i], '_')", _SUB),
    "feat_connected": _count("SELECT iid, 'CONNECTED' AS feature FROM joins WHERE length(path) - length(replace(path, '-', '')) = 2", _sub(None, False, 1)),
    "feat_node_path": _count("SELECT iid, path AS feature FROM sub", _NODE),
    "feat_node_path_end": _count("SELECT iid, path || ':' || node AS feature FROM sub", _NODE),
    "feat_matrix_text": _SUB + "SELECT i.iid, i.label, string_agg(f || ',1.0', ' -#- ' ORDER BY f) AS row FROM (SELECT iid, path AS f FROM joins UNION SELECT iid, 'bias' FROM joins) x JOIN inst i ON i.iid = x.iid GROUP BY i.iid, i.label",
    "feat_hashed": _count(f"SELECT iid, 'hash-' || CAST(((CASE WHEN c >= 2147483648 THEN c - 4294967296 ELSE c END) % 1000 + 1000) % 1000 AS VARCHAR) AS feature FROM (SELECT iid, list_reduce(list_transform(string_split(feature, ''), lambda x: CAST(unicode(x) AS BIGINT)), lambda h, x: (h * 31 + x) % 4294967296) AS c FROM ({_END}) e) h", _SUB),
    "negatives_sampled": _negatives("SELECT DISTINCT source, target FROM inst WHERE label = 1") + "SELECT source, target, -1 AS label FROM neg",
    "ppr_expected": _ppr(3),
    "path_prob_follow": _follow(["_placed_by", "from_supp", "supp_nation"]),
    "path_select_topk": _SUB + "SELECT path, count(DISTINCT iid) AS n_pairs FROM joins GROUP BY path ORDER BY n_pairs DESC, path LIMIT 5",
    "densify": f"WITH kg AS ({_kg()}), one AS (SELECT DISTINCT s, r, t FROM kg), sims(r1, r2, weight) AS (VALUES {_SIM}, ('in_nation', 'in_nation', 1.0), ('supp_nation', 'supp_nation', 1.0), ('in_region', 'in_region', 1.0), ('placed_by', 'placed_by', 1.0), ('has_part', 'has_part', 1.0), ('from_supp', 'from_supp', 1.0), ('brand', 'brand', 1.0)) SELECT s, r2 AS r, t, round(CAST(sum(weight) AS DOUBLE), 6) AS value FROM one JOIN sims ON one.r = sims.r1 GROUP BY s, r2, t",
    "score_linear": _SUB + f"SELECT 'in_nation' AS relation, iid, sum(CAST(coalesce(w, 0) AS DOUBLE)) AS score FROM (SELECT DISTINCT iid, feature FROM ({_BARE}) q) f LEFT JOIN (VALUES ('SOURCE:-_placed_by-', 0.5), ('TARGET:-in_region-', -1.25), ('TARGET:-_supp_nation-', 2.0)) AS g(feature2, w) ON f.feature = g.feature2 GROUP BY iid",
    "metric_ap_rr": _PRED + f"SELECT relation, {_round('ap', 'rr')} FROM whole",
    "metric_per_relation": _PRED + f"SELECT relation, {_round('ap', 'rr', 'query_map', 'query_mrr', 'predicted_map', 'predicted_mrr', 'no_prediction')} FROM per",
    "metric_dataset": _PRED + f"SELECT {_round('map', 'mrr', 'mmap', 'mmrr', 'predicted_mmap', 'predicted_mmrr')} FROM (SELECT avg(ap) AS map, avg(rr) AS mrr, avg(query_map) AS mmap, avg(query_mrr) AS mmrr, coalesce(avg(CASE WHEN predicted_map > -1 THEN predicted_map END), -1.0) AS predicted_mmap, coalesce(avg(CASE WHEN predicted_mrr > -1 THEN predicted_mrr END), -1.0) AS predicted_mmrr FROM per) x",
    "related_nodes_path": _KG + "SELECT DISTINCT 'c:' || CAST(c_custkey AS VARCHAR) AS start, k.t AS node FROM customer JOIN kg i ON i.r = 'placed_by' AND i.t = 'c:' || CAST(c_custkey AS VARCHAR) JOIN kg j ON j.r = 'from_supp' AND j.s = i.s JOIN kg k ON k.r = 'supp_nation' AND k.s = j.t",
    "unallowed_edges": "SELECT r FROM (VALUES ('in_nation'), ('supp_nation'), ('in_region')) AS x(r)",
}
