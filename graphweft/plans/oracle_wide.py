"""DuckDB SQL for plans.wide."""

from __future__ import annotations

from . import oracle as o
from .oracle_more import _REGIONS

_META = f"SELECT 'in/nation' AS relation, source, target, label FROM ({o.INST}) i WHERE label = 1 UNION ALL SELECT 'in_region', source, target, label FROM ({_REGIONS}) r"
_SPLIT = f"SELECT relation, CASE WHEN pos <= floor(CAST(0.7 AS DOUBLE) * n) THEN 'training' ELSE 'testing' END AS fold, source, target, label FROM (SELECT *, row_number() OVER (PARTITION BY relation, label ORDER BY source, target) AS pos, count(*) OVER (PARTITION BY relation, label) AS n FROM ({_META}) m) x"
_OWN = f"SELECT 'in_nation' AS relation, CASE WHEN pos <= floor(CAST(0.7 AS DOUBLE) * n) THEN 'training' ELSE 'testing' END AS fold, source, target, label FROM (SELECT *, row_number() OVER (ORDER BY source, target) AS pos, count(*) OVER () AS n FROM ({o.INST}) i WHERE label = 1) x"
_THREE = ["in_nation", "supp_nation", "in_region"]
_draw = lambda *c: f"CAST('0x' || substr(md5({' || '.join([*(x + chr(32) + chr(124) * 2 + chr(32) + chr(39) + chr(124) + chr(39) for x in c), chr(39) + '1' + chr(39)])}), 1, 13) AS BIGINT)"


def _predicted() -> str:
    q = o._walked(["in_nation", "in_region"]) + f", inst AS ({o.INST}), st AS (SELECT source AS n FROM (SELECT DISTINCT source FROM inst) z ORDER BY {_draw('source')}, source LIMIT 200)"
    q += o._shares("rank", "SELECT n FROM st", 3)
    q += ", best AS (SELECT start AS source, node AS target, row_number() OVER (PARTITION BY start ORDER BY share DESC, node) AS k FROM rank WHERE node IN (SELECT n FROM (" + o.NATIONS + ") z) AND NOT EXISTS (SELECT 1 FROM inst i WHERE i.label = 1 AND i.source = start AND i.target = node))"
    return q + f" SELECT source, target FROM best WHERE k <= 3 ORDER BY {_draw('source', 'target')}, source, target LIMIT 200"


def _sides() -> str:
    """Walks of 2 steps from either end, as in path_find_expected: fa and fb (iid, start, node, path, back, v)."""
    q = f"WITH kg AS ({o._kg(_THREE)}), adj0 AS ({o._ADJ}), st AS (SELECT n, l, m, count(*) AS k FROM adj0 GROUP BY n, l, m), dg AS (SELECT n, count(*) AS d FROM adj0 GROUP BY n), inst AS ({_REGIONS})"
    for f, end in (("a", "source"), ("b", "target")):
        q += f", {f}1 AS (SELECT iid, {end} AS start, st.m AS node, '-' || l || '-' AS path, '-' || {o._FLIP} || '-' AS back, CAST(k AS DOUBLE) / d AS w FROM inst JOIN st ON st.n = {end} JOIN dg ON dg.n = st.n WHERE st.m <> {end})"
        q += f", {f}2 AS (SELECT iid, start, st.m AS node, path || l || '-' AS path, '-' || {o._FLIP} || back AS back, w * k / d AS w FROM {f}1 x JOIN st ON st.n = x.node JOIN dg ON dg.n = st.n WHERE st.m <> x.node AND st.m <> x.start)"
        q += f", {f}m AS (SELECT iid, sum(w) AS m FROM {f}1 GROUP BY iid), {f}g AS (SELECT iid, start, node, path, back, sum(w) AS w, 1 AS h FROM {f}1 GROUP BY 1, 2, 3, 4, 5 UNION ALL SELECT iid, start, node, path, back, sum(w), 2 FROM {f}2 GROUP BY 1, 2, 3, 4, 5)"
        q += f", f{f} AS (SELECT g.iid, start, node, path, back, 100 * w * CASE WHEN h = 1 THEN 2 - m ELSE 1 END AS v FROM {f}g g JOIN {f}m m ON g.iid = m.iid)"
    return q


def _combined(paired: bool) -> str:
    keys = "iid, start, node" if paired else "start, node"
    q, p = _sides(), 2 if paired else 3
    for f in "ab":
        once = f"f{f}" if paired else f"(SELECT start, node, path, any_value(back) AS back, any_value(v) AS v FROM f{f} GROUP BY 1, 2, 3)"
        q += f", t{f} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY round(v, 9) DESC, path) AS k FROM {once} z) y WHERE k <= 5)"
    if paired:
        direct = f"SELECT t.path, power(v, {p}) AS c FROM ta t JOIN inst i ON i.iid = t.iid AND t.node = i.target UNION ALL SELECT t.back, power(v, {p}) FROM tb t JOIN inst i ON i.iid = t.iid AND t.node = i.source"
        met = "SELECT a.path || substr(b.back, 2), a.v * b.v FROM ta a JOIN tb b ON a.iid = b.iid AND a.node = b.node"
    else:
        direct = f"SELECT path, power(v, {p}) AS c FROM ta WHERE node IN (SELECT target FROM inst) UNION ALL SELECT back, power(v, {p}) FROM tb WHERE node IN (SELECT source FROM inst)"
        few = lambda f: f"(SELECT z.* FROM t{f} z JOIN (SELECT node, start, row_number() OVER (PARTITION BY node ORDER BY start) AS e FROM (SELECT DISTINCT node, start FROM t{f}) y) x ON z.node = x.node AND z.start = x.start WHERE e <= 9)"
        met = f"SELECT a.path || substr(b.back, 2), a.v * b.v FROM {few('a')} a JOIN {few('b')} b ON a.node = b.node"
    return q + f" SELECT path, round(CAST(sum(c) AS DOUBLE), 2) AS n_pairs FROM ({direct} UNION ALL {met}) z GROUP BY path"


def _walk_subgraph() -> str:
    q = _sides()
    for f in "ab":
        q += f", t{f} AS (SELECT iid, start, node, path FROM (SELECT *, row_number() OVER (PARTITION BY iid, start, node ORDER BY round(v, 9) DESC, path) AS k FROM f{f}) y WHERE k <= 10)"
    return q + " SELECT path, count(*) AS n FROM (SELECT * FROM ta UNION SELECT * FROM tb UNION SELECT a.iid, a.start, b.start, a.path || substr(b.back, 2) FROM fa a JOIN fb b ON a.iid = b.iid AND a.node = b.node) z GROUP BY path"


def _lexical() -> str:
    """Paths of up to 2 hops from either end, with the nodes they go through; both sides meet at one node."""
    q = f"WITH kg AS ({o._kg(_THREE)}), adj0 AS ({o._ADJ}), adj AS (SELECT n, l, m FROM adj0 a JOIN (SELECT n AS n2, r AS r2 FROM adj0 GROUP BY n, r HAVING count(*) <= 100) f ON a.n = f.n2 AND a.r = f.r2), inst AS ({_REGIONS})"
    for f, end in (("a", "source"), ("b", "target")):
        q += f", {f}1 AS (SELECT DISTINCT iid, source, target, a.m AS node, [l] AS p, [{o._FLIP}] AS back, [a.m] AS ns FROM inst x JOIN adj a ON a.n = x.{end})"
        q += f", {f}2 AS (SELECT DISTINCT iid, source, target, a.m AS node, list_append(p, l) AS p, list_prepend({o._FLIP}, back) AS back, list_append(ns, a.m) AS ns FROM {f}1 x JOIN adj a ON a.n = x.node)"
        q += f", {f} AS (SELECT * FROM {f}1 UNION ALL SELECT * FROM {f}2)"
    q += ", every AS (SELECT iid, p, ns[1:len(ns)-1] AS ns FROM a WHERE node = target UNION SELECT iid, back, list_reverse(ns[1:len(ns)-1]) FROM b WHERE node = source"
    q += " UNION SELECT a.iid, list_concat(a.p, b.back), list_concat(a.ns, list_reverse(b.ns[1:len(b.ns)-1])) FROM a JOIN b ON a.iid = b.iid AND a.node = b.node)"
    text = "array_to_string(list_transform(range(1, len(p) + 1), lambda i: '-' || p[i] || '->' || coalesce(ns[i], '')), '')"
    return q + f" SELECT feature, count(*) AS n FROM (SELECT DISTINCT iid, {text} AS feature FROM every) z GROUP BY feature"


def _metrics() -> str:
    """Long metrics of both experiments: m (experiment, relation, metric, value)."""
    body = o._PRED.strip()
    names = ["ap", "rr", "query_map", "query_mrr", "predicted_map", "predicted_mrr", "no_prediction"]
    long = lambda t, e: " UNION ALL ".join(f"SELECT '{e}' AS experiment, relation, '{n}' AS metric, CAST({n} AS DOUBLE) AS value FROM {t}" for n in names)
    over = lambda t, e: " UNION ALL ".join(f"SELECT '{e}', '__DATASET__', '{n}', CAST({x} AS DOUBLE) FROM {t}" for n, x in {"map": "avg(ap)", "mrr": "avg(rr)", "mmap": "avg(query_map)", "mmrr": "avg(query_mrr)", "predicted_mmap": "coalesce(avg(CASE WHEN predicted_map > -1 THEN predicted_map END), -1.0)", "predicted_mmrr": "coalesce(avg(CASE WHEN predicted_mrr > -1 THEN predicted_mrr END), -1.0)"}.items())
    second = body[body.index("r1 AS") :]
    for t in ("r1", "r2", "whole", "each", "per"):
        second = second.replace(f"{t} AS (", f"e_{t} AS (").replace(f"FROM {t} ", f"FROM e_{t} ").replace(f"FROM {t})", f"FROM e_{t})")
    second = second.replace("FROM kept", "FROM e_kept")
    return body + ", e_kept AS (SELECT * FROM kept WHERE CAST(floor(score) AS BIGINT) % 2 = 0), " + second + f", m AS ({long('per', 'all')} UNION ALL {over('per', 'all')} UNION ALL {long('e_per', 'even')} UNION ALL {over('e_per', 'even')}) "


_NAME = "CASE WHEN starts_with({0}, 'n:') THEN (SELECT n_name FROM nation WHERE 'n:' || CAST(n_nationkey AS VARCHAR) = {0}) ELSE {0} END"

_NODES = "SELECT source, label FROM (SELECT 'c:' || CAST(c_custkey AS VARCHAR) AS source, CASE WHEN c_nationkey < 5 THEN 1 ELSE -1 END AS label, row_number() OVER (PARTITION BY c_nationkey < 5 ORDER BY 'c:' || CAST(c_custkey AS VARCHAR)) AS pos, count(*) OVER (PARTITION BY c_nationkey < 5) AS n FROM customer) z WHERE pos > floor(CAST(0.75 AS DOUBLE) * n)"

ORACLE_SQL = {
    "experiment_nodes": o._NODE + f"SELECT x.source, x.label, f.path AS feature, CAST(1 AS DOUBLE) AS value FROM ({_NODES}) x JOIN (SELECT DISTINCT start, path FROM sub) f ON f.start = x.source",
    "split_from_metadata": _SPLIT,
    "split_with_negatives": o._negatives(f"SELECT source, target FROM ({_OWN}) own WHERE fold = 'testing'", known=f"SELECT source, target FROM ({_OWN}) own2") + f"SELECT relation, fold, source, target, label FROM ({_OWN}) s UNION ALL SELECT 'in_nation', 'testing', source, target, -1 FROM neg",
    "potential_predictions": _predicted(),
    "feat_pra_with_nodes": _lexical(),
    "node_names_colons": f"SELECT s, split_part(s, ':', 2) AS last, split_part(t, ':', 2) AS kept, '' AS removed FROM ({o._kg(['in_region'])}) k",
    "walk_counts_paired": _combined(True),
    "walk_counts_everything": _combined(False),
    "walk_subgraphs": _walk_subgraph(),
    "related_nodes_union": o._KG + ", c AS (SELECT 'c:' || CAST(c_custkey AS VARCHAR) AS n FROM customer) SELECT n AS start, k.t AS node FROM c JOIN kg k ON k.r = 'in_nation' AND k.s = n UNION SELECT n, j.t FROM c JOIN kg k ON k.r = 'in_nation' AND k.s = n JOIN kg j ON j.r = 'in_region' AND j.s = k.t UNION SELECT n, k.t FROM c JOIN kg i ON i.r = 'placed_by' AND i.t = n JOIN kg j ON j.r = 'from_supp' AND j.s = i.s JOIN kg k ON k.r = 'supp_nation' AND k.s = j.t",
    "kg_counts": o._KG + "SELECT (SELECT count(*) FROM (SELECT s FROM kg UNION SELECT t FROM kg) n) AS nodes, (SELECT count(DISTINCT r) FROM kg) AS relations, (SELECT count(*) FROM kg) AS edges",
    "kg_grouped_lists": o._KG + "SELECT n, r, coalesce(string_agg(i, ' ' ORDER BY i), '') AS ins, coalesce(string_agg(u, ' ' ORDER BY u), '') AS outs FROM (SELECT s AS n, r, NULL AS i, t AS u FROM kg UNION ALL SELECT t, r, s, NULL FROM kg) z GROUP BY n, r",
    "kg_node": o._KG + "SELECT r AS l, t AS m FROM kg WHERE s = 'n:3' UNION ALL SELECT '_' || r, s FROM kg WHERE t = 'n:3'",
    "kg_without_tests": o._KG + f", sp AS (SELECT replace(relation, '/', '_') AS r, source, target FROM ({_SPLIT}) z WHERE fold = 'testing') SELECT s, r, t FROM kg WHERE NOT EXISTS (SELECT 1 FROM sp WHERE sp.r = kg.r AND ((sp.source = kg.s AND sp.target = kg.t) OR (sp.source = kg.t AND sp.target = kg.s)))",
    "sink_edges": o._kg(_THREE),
    "sink_edges_binary": "SELECT CAST(c_custkey AS INTEGER) AS s, CAST(c_nationkey AS INTEGER) AS t, CAST(1 AS INTEGER) AS r FROM customer",
    "sink_dense_matrices": f"WITH one AS (SELECT DISTINCT s, r, t FROM ({o._kg(['in_nation', 'in_region'])}) k), sims(r1, r2, weight) AS (VALUES {o._SIM}) SELECT r2 AS r, s, t, round(CAST(sum(weight) AS DOUBLE), 6) AS value FROM one JOIN sims ON one.r = sims.r1 GROUP BY s, r2, t",
    "sink_split": _SPLIT,
    "sink_metrics": _metrics() + "SELECT experiment, relation, metric, round(value, 6) AS value FROM m",
    "scorer_significance": _metrics() + ", d AS (SELECT row_number() OVER (ORDER BY relation) - 1 AS i, round(a.value, 6) - round(b.value, 6) AS d FROM (SELECT * FROM m WHERE experiment = 'all' AND metric = 'ap') a JOIN (SELECT relation, value FROM m WHERE experiment = 'even' AND metric = 'ap') b USING (relation)), f AS (SELECT unnest(range(0, (SELECT CAST(1 AS BIGINT) << count(*) FROM d))) AS id), x AS (SELECT id, abs(sum(CASE WHEN (id >> i) & 1 = 1 THEN -d ELSE d END)) AS x FROM f CROSS JOIN d GROUP BY id) SELECT 'all' AS first, 'even' AS second, round(avg(CASE WHEN x >= (SELECT abs(sum(d)) FROM d) - 1e-12 THEN 1.0 ELSE 0.0 END), 6) AS p FROM x",
    "ingest_schema": "SELECT 'a' AS a, 'b' AS b, 'inverse' AS kind UNION ALL SELECT n_name, CAST(n_regionkey AS VARCHAR), 'domain' FROM nation UNION ALL SELECT n_name, 'range', 'range' FROM nation",
    "ingest_dump": f"SELECT t AS a, s AS b FROM ({o._kg(['in_nation', 'in_region'])}) k",
    "display_names": f"SELECT iid, source, {_NAME.format('target')} AS target FROM ({o.INST}) i",
}
