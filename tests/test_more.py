"""Vectors, walks, generator, kernels, rankings, specifications and experiments."""

import json
import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphweft.operators import features, graph, models, paths, ranking, vectors, walks
from graphweft.plans import experiment, more, oracle_more
from graphweft.sources import specs, synthetic

EDGES = [("a", "r", "b"), ("a", "r", "c"), ("a", "q", "d"), ("b", "r", "d"), ("c", "r", "d"), ("d", "q", "e")]


def _edges(spark):
    return spark.createDataFrame(EDGES, "s string, r string, t string")


def _inst(spark, rows=(("a", "d"),)):
    return spark.createDataFrame([(i, s, t, 1) for i, (s, t) in enumerate(rows)], "iid long, source string, target string, label int")


def _simulated(start, steps, n=200_000, restart=0.0, seed=3):
    rng, adj = np.random.default_rng(seed), {}
    for s, r, t in EDGES:
        adj.setdefault(s, []).append((r, t))
        adj.setdefault(t, []).append(("_" + r, s))
    seen = Counter()
    for _ in range(n):
        path, nodes = [], [start]
        for _ in range(steps):
            l, m = adj[nodes[-1]][rng.integers(len(adj[nodes[-1]]))]
            if rng.random() < restart or m in nodes:
                path, nodes = [], [start]
                continue
            path, nodes = [*path, l], [*nodes, m]
            seen["-" + "-".join(path) + "-", m] += 1
    return {k: v / n for k, v in seen.items()}


@pytest.mark.parametrize("restart", [0.0, 0.3])
def test_found_paths_against_simulation(spark, restart):
    got = walks.found_paths(_inst(spark), "source", graph.both_ways(_edges(spark)), 1, 3, restart).select(paths.encode(F.col("path")).alias("p"), "node", "visits").collect()
    got, want = {(r["p"], r["node"]): r["visits"] for r in got}, _simulated("a", 3, restart=restart)
    assert set(want) <= set(got) and all(abs(v - want.get(k, 0)) < 0.01 for k, v in got.items())


def test_page_rank_by_edges_against_simulation(spark):
    got = {r["node"]: r["visits"] for r in walks.page_rank_edges(spark.createDataFrame([("a",)], "n string"), graph.both_ways(_edges(spark)), 1, 3).collect()}
    rng, adj, seen, n = np.random.default_rng(5), {}, Counter(), 100_000
    for s, _, t in EDGES:
        adj.setdefault(s, []).append(t)
        adj.setdefault(t, []).append(s)
    for _ in range(n):
        at = "a"
        for _ in range(3):
            at = "a" if rng.random() < 0.15 else adj[at][rng.integers(len(adj[at]))]
            seen[at] += 1
    assert all(abs(v - seen[k] / n) < 0.01 for k, v in got.items()) and "a" not in got


def test_follow_paths_is_follow(spark):
    adj, a = graph.both_ways(_edges(spark)), spark.createDataFrame([("a",)], "n string")
    of = spark.createDataFrame([(["r"],), (["r", "r"],), (["q", "_r"],), (["x"],)], "path array<string>")
    got = {(tuple(r["path"]), r["target"]): r["p"] for r in walks.follow_paths(a, adj, of).collect()}
    want = {(p, r["target"]): r["p"] for p in (("r",), ("r", "r"), ("q", "_r")) for r in walks.follow(a, adj, list(p)).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)
    closed = spark.createDataFrame([("b", "r", "d")], "n string, l string, m string")
    got = {tuple(r["path"]): r["p"] for r in walks.follow_paths(a, adj, of, False, 1, closed).where("target = 'd'").collect()}
    assert got == {("r", "r"): 0.5}
    assert walks.follow_paths(a, adj, of.limit(0)).count() == 0


def test_decomposition_against_numpy(spark):
    e = spark.createDataFrame([(f"s{i % 7}", f"r{(i * i + i // 5) % 4}", f"t{i % 3}") for i in range(60)], "s string, r string, t string")
    pairs, rel = sorted({(r["s"], r["t"]) for r in e.collect()}), sorted({r["r"] for r in e.collect()})
    a = np.zeros((len(pairs), len(rel)))
    for r in e.collect():
        a[pairs.index((r["s"], r["t"])), rel.index(r["r"])] += 1
    _, s, vt = np.linalg.svd(a, full_matrices=False)
    v = vt[:3].T * np.sqrt(s[:3])
    want = v / np.linalg.norm(v, axis=1, keepdims=True)
    got = {r["r"]: np.array(r["v"]) for r in vectors.decomposed(e, 3).collect()}
    g = np.stack([got[x] for x in rel])
    assert np.allclose(np.abs(g), np.abs(want), atol=1e-6) and np.allclose(g @ g.T, want @ want.T, atol=1e-6)
    assert vectors.decomposed(e.limit(0), 3).count() == 0


def test_hyperplane_hashing(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(20, 8))
    rows = [(f"v{i}{k}", [float(x) for x in base[i] + 0.01 * k * rng.normal(size=8)]) for i in range(20) for k in range(2)]
    v = spark.createDataFrame([*rows, ("zero", [0.0] * 8), ("none", None), ("nan", [float("nan")] * 8)], vectors.VECTORS)
    got = {(r["r1"], r["r2"]): r["weight"] for r in vectors.similar_hashed(v, 0.9, 2.0, 8, 6).collect()}
    want = {(r["r1"], r["r2"]): r["weight"] for r in models.similar_pairs(vectors.unit(v), 0.9).collect()}
    assert set(got) <= set(want) and len(got) >= 0.95 * len(want) and all((b, a) in got for a, b in got)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert not [r for r in vectors.similar_hashed(v, -2.0, 2.0, 2, 1, most=1, ignore=["v00"]).collect() if "v00" in (r["r1"], r["r2"])]
    with pytest.raises(ValueError):
        vectors.hashed(v, 1, 63)


def test_path_clusters(spark):
    v = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.9, 0.1]), ("z", [0.0, 2.0])], vectors.VECTORS)
    c = spark.createDataFrame([(["x", "k"], 3), (["y", "k"], 1), (["z", "k"], 2), (["_x", "k"], 5), (["k"], 7)], "path array<string>, n_pairs long")
    got = {r["path"]: r["n_pairs"] for r in vectors.clustered_paths(c, v, 0.8).collect()}
    assert got == {"-x C+C y-k-": 4, "-z-k-": 2, "-_x-k-": 5, "-k-": 7}
    assert [r["path"] for r in vectors.clustered_paths(c, v, 0.8, 1).collect()] == ["-k-"]


def test_walks_of_similar_relations(spark):
    v = spark.createDataFrame([("r", [1.0, 0.0]), ("q", [0.0, 1.0])], vectors.VECTORS)
    got = {r["l"]: r["q"] for r in vectors.next_label(graph.both_ways(_edges(spark)), "r", v, 2.0, 0.5).where("n = 'a'").collect()}
    total = np.exp(2) + 1 + 0.5
    assert abs(got["r"] - np.exp(2) / total) < 1e-12 and abs(got["q"] - 1 / total) < 1e-12
    assert [r["q"] for r in vectors.next_label(graph.both_ways(_edges(spark)), "r", v, 2.0, 0.5).where("n = 'b'").collect()] == [1.0]
    assert {r["l"] for r in vectors.next_label(graph.both_ways(_edges(spark)), "q", v.where("r = 'r'"), 2.0, 0.5).collect()} == {"q"}


@pytest.mark.parametrize("kernel", ["linear", "quadratic", "rbf"])
def test_kernel_machines(spark, kernel):
    rows = [("k", i, 1 if (i & 1) == (i >> 1 & 1) else -1, f, 1.0) for i in range(16) for f in ("a" if i & 1 else "b", "c" if i & 2 else "d")]
    f = spark.createDataFrame(rows, "relation string, iid long, label int, feature string, value double")
    s = models.kernel_svm(f, kernel, 0.5, 10.0).cache()
    got = {r["iid"]: r["score"] for r in models.kernel_scores(f, s, kernel, 0.5).collect()}
    support = s.collect()
    x = {i: {f for _, j, _, f, _ in rows if j == i} for i in range(16)}
    for i in range(16):
        k = [len(x[i] & set(r["features"])) for r in support]
        k = {"linear": k, "quadratic": [v * v for v in k], "rbf": [np.exp(-0.5 * (4 - 2 * v)) for v in k]}[kernel]
        assert abs(got[i] - sum(r["alpha"] * v for r, v in zip(support, k))) < 1e-9
    right = sum((got[i] > 0) == ((i & 1) == (i >> 1 & 1)) for i in range(16))
    assert right == 16 if kernel != "linear" else right < 16  # the label is no linear function
    with pytest.raises(ValueError):
        models.kernel_svm(f, "other")


def test_generator(spark):
    p = synthetic.Plan(entities=50, bases=3, targets=2, training=30, testing=10, rules=2, longest=2, chance=1.0, spread=0.0, training_names=2, overlapping=5, base_noise=5, noise_relations=2, noise=5)
    e, inst, body = synthetic.generated(spark, p)
    rows, again = {tuple(r) for r in e.collect()}, {tuple(r) for r in synthetic.generated(spark, p)[0].repartition(5).collect()}
    assert rows == again and inst.where("label = 1").groupBy("relation", "fold").count().count() == 4
    assert {r[1] for r in rows if r[1].startswith("noise")} == {"noise_01", "noise_02"}
    by = {}
    for s, r, t in rows:
        by.setdefault("_".join(r.split("_")[:2]), set()).add((s, t))
    for r in body.where("positive").collect():  # rules fire for sure, so each body joins each positive pair
        for x in inst.where((F.col("relation") == r["relation"]) & (F.col("label") == 1)).collect():
            at = {x["source"]}
            for b in r["body"]:
                at = {t for s, t in by[f"base_{b:02d}"] if s in at}
            assert x["target"] in at
    assert {(x["source"], x["relation"], x["target"]) for x in inst.where("label = 1 and fold = 'training'").collect()} <= rows


def test_candidates(spark):
    adj = graph.both_ways(_edges(spark))
    tests, training = _inst(spark, [("a", "e")]), _inst(spark, [("a", "b")])
    got = {(r["source"], r["target"]) for r in ranking.candidates(tests, training, adj, 2).collect()}
    assert ("a", "b") not in got and all("a" == s or "e" == t for s, t in got) and len(got) <= 4
    w = spark.createDataFrame([("-r-r-", 2.0)], "feature string, weight double")
    best = ranking.ranked(tests, training, adj, w, features.pra).first()
    assert (best["source"], best["target"], best["score"]) == ("a", "d", 2.0)


def test_specifications(tmp_path):
    (tmp_path / "base.json").write_text('{"operation": {"type": "train and test", "learning": {"l2 weight": 1}}, "graph": "x"}')
    (tmp_path / "kb.json").write_text('{"name": "kb"}')
    (tmp_path / "one.json").write_text('load base\n{"graph": "load kb", "operation": {"learning": {"l1 weight": 2}}}')
    got = specs.read(tmp_path / "one.json", tmp_path)
    assert got == {"operation": {"type": "train and test", "learning": {"l2 weight": 1, "l1 weight": 2}}, "graph": {"name": "kb"}}
    (tmp_path / "loop.json").write_text("load loop\n{}")
    with pytest.raises(ValueError):
        specs.read(tmp_path / "loop.json", tmp_path)
    (tmp_path / "done" / "one").mkdir(parents=True)
    assert [p.stem for p in specs.found(tmp_path, ["one", "kb"], tmp_path / "done")] == ["kb"]
    with pytest.raises(ValueError):
        specs.known_keys({"stepz": 1}, ["steps"], "x")


@pytest.mark.parametrize("kind", ["subgraphs", "pra"])
def test_experiment(spark, tmp_path, kind):
    rows = [(f"s{i}", "r1", f"m{i}") for i in range(20)] + [(f"m{i}", "r2", f"t{i}") for i in range(20)] + [(f"s{i}", "goal", f"t{i}") for i in range(10)]
    rows += [(f"s{i}", "r3", f"t{(i + 1) % 20}") for i in range(20)]
    e = spark.createDataFrame(rows, "s string, r string, t string")
    split = spark.createDataFrame([("goal", "training" if i < 10 else "testing", f"s{i}", f"t{(i + k) % 20}", 1 - 2 * k) for i in range(20) for k in range(2)], "relation string, fold string, source string, target string, label int")
    spec = {"operation": {"features": {"type": kind, "path finder": {"path finding iterations": 2} if kind == "pra" else {"number of steps": 2}}, "learning": {"l2 weight": 0.1}}}
    r = experiment.train_and_test(spark, spec, split, e)
    w = {x["feature"]: x["weight"] for x in r.weights.collect()}
    assert w["-r1-r2-"] > 0 > w["-r3-"] and "-goal-" not in w
    got = {(x["source"], x["target"]): (x["score"], x["label"]) for x in r.scores.collect()}
    assert all((s > 0) == (y > 0) for s, y in got.values()) and len(got) >= 20
    experiment.write(r, f"{tmp_path}/out", matrices=True)
    back = experiment.read_scores(spark, f"{tmp_path}/out").collect()
    assert {(x["source"], x["target"]): x["score"] for x in back} == {k: s for k, (s, _) in got.items()}
    assert all(x["correct"] == (got[x["source"], x["target"]][1] > 0) for x in back)
    with pytest.raises(ValueError):
        experiment.train_and_test(spark, {"operation": {"type": "other"}}, split, e)
    if kind == "subgraphs":
        rbf = {"operation": {"features": {"type": kind}, "learning": {"type": "SVM", "kernel": {"type": "rbf", "gamma": 0.5}, "max training examples": 19}}}
        k = experiment.train_and_test(spark, rbf, split, e).scores.collect()
        assert len(k) == 20 and all((x["score"] > 0) == (x["label"] > 0) for x in k)


def test_generated_graph_of_a_specification(spark, tmp_path):
    (tmp_path / "kb.tsv").write_text("a\tb\tr\n")
    spec = {"relation sets": [{"relation file": str(tmp_path / "kb.tsv"), "relation prefix": "p-"}, {"type": "generated", "generation params": {"num_entities": 9, "num_base_relations": 2, "num_pra_relations": 1, "num_pra_relation_training_instances": 3, "num_pra_relation_testing_instances": 1, "num_rules": 1}}]}
    got = {tuple(r) for r in experiment.graph(spark, json.loads(json.dumps(spec))).collect()}
    assert ("a", "p-r", "b") in got and len(got) > 3


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="driver's tables")
@pytest.mark.parametrize("name", ["feat_catcomp", "feat_numcomp", "feat_anyrel_alias", "ppr_edges", "path_find_expected", "path_follow_similar", "metric_permutation_exact", "sim_exact"])
def test_against_sql(spark, name):
    import duckdb

    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    got, want = more.QUERIES[name](spark, sf).toPandas(), con.execute(oracle_more.ORACLE_SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda d: sorted(str(tuple(float(v) if isinstance(v, float) else v for v in r)) for r in d[cols].itertuples(index=False))
    assert rows(got) == rows(want)


def test_alias_paths_are_joined_without_the_subgraph(spark):
    """Only paths that join the ends are read, so what either end reaches is not stored for each pair."""
    import __spark_entry__
    from graphweft.functions import tables

    tables.clear(spark)
    assert __spark_entry__.queries()["feat_anyrel_alias"](spark, "/root/testdata/sf0.001").count()
    stored = [spark.read.parquet(x) for x in tables._STORED]
    assert stored and not any({"iid", "node"} <= set(x.columns) for x in stored)


@pytest.mark.parametrize("kernel", ["quadratic", "rbf"])
def test_kernel_machines_train_on_all_rows(spark, kernel, monkeypatch):
    """More rows than 4,096, against coordinate descent that keeps a value for each row; kernel values kept and worked out anew."""
    rng = np.random.default_rng(2)
    x = np.hstack([(rng.random((4500, 4)) < 0.5) * np.array([1.0, 2.0, 1.0, 0.5]), np.ones((4500, 1))])
    y = np.where(rng.random(4500) < 0.2 + 0.6 * (x[:, 0] != x[:, 2]), 1, -1)
    own = [[[f"f{j}", float(v)] for j, v in enumerate(r) if v] for r in x]
    f = spark.createDataFrame([("r", i, int(y[i]), o) for i, o in enumerate(own)], "relation string, iid long, label int, o array<struct<feature:string,value:double>>").selectExpr("relation", "iid", "label", "inline(o)")
    k = x @ x.T
    n = k.diagonal()
    k = k * k if kernel == "quadratic" else np.exp(-0.5 * (n[:, None] + n[None] - 2 * k))
    alpha, z = np.zeros(4500), np.zeros(4500)
    for _ in range(3):
        for r in range(4500):
            new = min(1.0, max(0.0, alpha[r] - (y[r] * z[r] - 1) / k[r, r]))
            z += (new - alpha[r]) * y[r] * k[r]
            alpha[r] = new
    for most in (models.KEPT_VALUES, 1):
        monkeypatch.setattr(models, "KEPT_VALUES", most)
        got = models.kernel_svm(f, kernel, 0.5, 1.0, 3).collect()
        kinds = {tuple(map(tuple, o)) for o in own}
        want = {t: sum(alpha[i] * y[i] for i, o in enumerate(own) if tuple(map(tuple, o)) == t) for t in kinds}
        mine = {tuple(sorted(r["features"].items())): r["alpha"] for r in got}
        assert len(got) == len(mine) and all(abs(mine.get(t, 0.0) - v) < 1e-6 * max(1.0, abs(v)) for t, v in want.items())
        assert len([i for i in range(4500) if alpha[i]]) > 100 and min(r["of"] for r in got) == np.flatnonzero(alpha)[0]


def test_sides_of_a_training_task_share_no_columns(spark):
    """Spark has dropped a column that both sides of a cogroup had from one plan."""
    f = spark.createDataFrame([("r", i, 1, "a", 1.0) for i in range(3)], "relation string, iid long, label int, feature string, value double")
    out = lambda df: {x.strip() for x in df._jdf.queryExecution().analyzed().output().mkString(",").split(",")}
    one, two = map(out, models._kinds(f))
    assert len(one) == 4 and len(two) == 4 and not one & two
