"""Splits, lexicalised paths, numbering, writers and readers, scoring of experiments, trainers against plain ones."""

import itertools
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphweft.functions import numbering, tables
from graphweft.operators import datasets, graph, lexicalised, models, paths, walks
from graphweft.plans import experiment, scorer, wide
from graphweft.sources import ingest, sinks


def edges(spark, rows):
    return spark.createDataFrame(rows, "s string, r string, t string")


def test_numbered(spark):
    rows = [(i % 3, (i * 7919) % 1000, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "g int, x int, i int").repartition(7)
    got = {r["i"]: r["pos"] for r in numbering.numbered(df, ["x", "i"]).collect()}
    assert got == {r[2]: k for k, r in enumerate(sorted(rows, key=lambda r: r[1:]), 1)}
    got = {r["i"]: r["pos"] for r in numbering.numbered(df.withColumn("g", F.when(F.col("g") > 0, F.col("g"))), ["x", "i"], ["g"]).collect()}
    want = {}
    for g in range(3):
        want |= {r[2]: k for k, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: r[1:]), 1)}
    assert got == want
    assert numbering.numbered(df.limit(0), ["x"]).count() == 0


def test_stored_tables_go(spark):
    tables.clear(spark)
    df = tables.stored(spark.range(5), "x")
    assert df.count() == 5 and tables.clear(spark) == 1 and tables.clear(spark) == 0


def test_shares_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(1)
    rows = [(f"n{a}", f"r{c}", f"n{b}") for a, b, c in rng.integers(0, [40, 40, 3], (400, 3))]
    starts = spark.createDataFrame([(f"n{i}",) for i in range(5)], "n string")
    one, two = (graph.both_ways(edges(spark, rows).repartition(n)) for n in (1, 9))
    for fn in (lambda a: walks.page_rank(starts, a), lambda a: walks.page_rank_edges(starts, a), lambda a: walks.follow(starts, a, ["r0", "_r1"])):
        assert sorted(map(tuple, fn(one).collect())) == sorted(map(tuple, fn(two).collect()))


def test_negatives_of_both_ends(spark):
    near = [(f"s{i}", "in", f"t{i % 3}") for i in range(12)]
    adj = graph.both_ways(edges(spark, near))
    pos = spark.createDataFrame([(f"s{i}", f"t{i % 3}") for i in range(6)], "source string, target string")
    other = spark.createDataFrame([("s6", "t0")], "source string, target string")
    ok = lambda p: spark.createDataFrame([(f"{p}{i}",) for i in range(12)], "n string")
    got = [tuple(r) for r in datasets.ranked_negatives(pos, adj, other, ok("s"), ok("t"), ratio=2, steps=3).collect()]
    known = {(r[0], r[1]) for r in [*pos.collect(), *other.collect()]}
    assert got and not {(a, b) for a, b, _ in got} & known and all(x == -1 for *_, x in got)
    assert all(a[0] == "s" and b[0] == "t" for a, b, _ in got)
    assert any(a not in {f"s{i}" for i in range(6)} for a, _, _ in got)  # sources are drawn too
    with pytest.raises(ValueError):
        datasets.split_from_metadata(pos.withColumn("relation", F.lit("r")).withColumn("label", F.lit(1)), edges(spark, near), [], 0.5)
    with pytest.raises(ValueError):
        datasets.with_negatives(pos, edges(spark, near), adj, "neither")


def test_predictions_leave_known_pairs_out(spark):
    adj = graph.both_ways(edges(spark, [(f"s{i}", "in", f"t{i % 2}") for i in range(6)] + [("t0", "of", "u"), ("t1", "of", "u")]))
    known = spark.createDataFrame([("s0", "t0")], "source string, target string")
    fits = spark.createDataFrame([("t0",), ("t1",)], "n string")
    got = {tuple(r) for r in datasets.potential_predictions(spark.createDataFrame([("s0",), ("s1",)], "n string"), adj, known, fits, ratio=1).collect()}
    assert got == {("s0", "t1"), ("s1", "t1")}


def test_lexicalised_paths(spark):
    one = spark.createDataFrame([(["a", "_b"], ["x", "m"], ["c"], ["m"])], "p array<string>, n array<string>, q array<string>, k array<string>")
    path, nodes = lexicalised.joined(F.col("p"), F.col("n"), F.col("q"), F.col("k"))
    assert tuple(one.select(path, nodes).first()) == (["a", "_b", "_c"], ["x", "m"])
    text = one.select(lexicalised.encode(F.col("p"), F.col("n")).alias("t"), lexicalised.encode(path, nodes).alias("u"), lexicalised.labels_only(F.col("p")).alias("v"))
    assert tuple(text.first()) == ("-a->x-_b->m", "-a->x-_b->m-_c->", "-a-_b-")
    for c, want in (("t", (["a", "_b"], ["x", "m"])), ("u", (["a", "_b", "_c"], ["x", "m"]))):
        assert tuple(text.select(*lexicalised.parse(F.col(c))).first()) == want
    none = one.select(*lexicalised.joined(F.col("p"), F.col("n"), F.array().cast("array<string>"), F.array().cast("array<string>"))).first()
    assert tuple(none) == (["a", "_b"], ["x"])
    assert tuple(one.select(*lexicalised.reversed_nodes(F.col("p"), F.col("n"))).first()) == (["b", "_a"], ["m", "x"])
    with pytest.raises(Exception, match="different nodes"):
        one.select(lexicalised.joined(F.col("p"), F.col("n"), F.col("q"), F.array(F.lit("z")))[1]).collect()
    with pytest.raises(Exception, match="can't be joined again"):
        one.select(lexicalised.joined(F.col("p"), F.array(F.lit("m")), F.col("q"), F.col("k"))[1]).collect()
    names = spark.createDataFrame([("plain",), ("a:KEEP:b:c",), ("a:REMOVE:b",)], "x string")
    assert [r[0] for r in names.select(lexicalised.shown(F.col("x"), "filter")).collect()] == ["plain", "c", ""]
    assert [r[0] for r in names.select(lexicalised.shown(F.col("x"), "yes")).collect()] == ["plain", "c", "b"]
    with pytest.raises(Exception, match="neither KEEP"):
        names.limit(1).select(lexicalised.shown(F.lit("a:b:c"), "filter")).collect()


def test_joining_paths_are_those_of_the_subgraph(spark):
    rng = np.random.default_rng(3)
    rows = [(f"n{a}", f"r{c}", f"n{b}") for a, b, c in rng.integers(0, [14, 14, 2], (40, 3))]
    adj = graph.both_ways(edges(spark, rows))
    inst = spark.createDataFrame([(i, f"n{i}", f"n{(i * 5 + 1) % 14}", 1) for i in range(10) if i != (i * 5 + 1) % 14], "iid int, source string, target string, label int")
    sub = paths.pair_subgraph(inst, adj, 2, ["r0"]).join(inst.select("iid", "source", "target"), "iid").where("start = source and node = target")
    want = {(r["iid"], tuple(r["path"])) for r in sub.collect()}
    assert want and {(r["iid"], tuple(r["path"])) for r in paths.pair_paths(inst, adj, 2, ["r0"]).collect()} == want
    lexical = lexicalised.between(inst, adj, 2, ["r0"]).collect()
    assert {(r["iid"], tuple(r["path"])) for r in lexical} == want and all(len(r["nodes"]) == len(r["path"]) - 1 for r in lexical)


def test_graph_is_written_and_read(spark, tmp_path):
    rows = [("a", "r1", "b"), ("b", "r2", "c"), ("a", "r1", "c"), ("a", "r1", "b"), ("c", "r3", "a")]
    e = edges(spark, rows)
    for binary in (False, True):
        at = f"file://{tmp_path}/g{binary}"
        sinks.write_graph(e, at, binary, not binary, sharded=True, matrices=3)
        nodes, relations = ({r["id"]: r["name"] for r in spark.read.csv(f"{at}/{f}", sep="\t", schema="id int, name string").collect()} for f in ("node_dict.tsv", "edge_dict.tsv"))
        assert nodes == {1: "a", 2: "b", 3: "c"} and relations == {1: "r1", 2: "r2", 3: "r3"}
        got = sorted((nodes[r["s"]], relations[r["r"]], nodes[r["t"]]) for r in sinks.read_edges(spark, at).collect())
        assert got == sorted(rows)
        files = {(r["r"], r["file"]) for r in sinks.read_matrices(spark, f"{at}/matrices").collect()}
        assert files == {("1", "1"), ("2", "2-3"), ("3", "2-3")}
    big = spark.createDataFrame([(2**31 - 1, -1, 0)], "s int, t int, r int")
    sinks.write_edges(big, f"file://{tmp_path}/big", True, False)
    assert [tuple(r) for r in sinks.read_edges(spark, f"file://{tmp_path}/big").collect()] == [(2**31 - 1, -1, 0)]
    assert [sinks.shards(n) for n in (0, 4_999_999, 5_000_000, 10**9)] == [2, 2, 3, 10]
    assert graph.prefixes(["x", None, "y", "x"]) == {"x": "1-", "y": "2-"} and graph.prefixes(["x"]) == {}
    assert graph.has_node(e, "c") and not graph.has_node(e, "z") and graph.has_edge(e, "a", "r1", "c") and not graph.has_edge(e, "c", "r1", "a")


def test_split_is_written_and_read(spark, tmp_path):
    rows = [("a/b", "training", "x", "y", 1), ("a/b", "testing", "x", "z", -1), ("c", "training", "é", "w w", 1)]
    split = spark.createDataFrame(rows, "relation string, fold string, source string, target string, label int")
    sinks.write_split(split, f"{tmp_path}/splits/one", {"p": 1})
    assert sorted(map(tuple, sinks.read_split(spark, {"name": "one"}, str(tmp_path)).collect())) == sorted(rows)
    assert json.loads(spark.read.text(f"{tmp_path}/splits/one/params.json").first()[0]) == {"p": 1}
    assert sinks.split_folder("/x/", "b") == "/x" and sinks.split_folder("n", "b") == "b/splits/n"
    with pytest.raises(ValueError):
        sinks.split_folder({}, "b")
    private = spark.createDataFrame([("s", "t", 1, [("s", "r", "t")])], "source string, target string, label int, graph array<struct<s:string,r:string,t:string>>")
    assert sinks.instance_lines(private).first()[0] == "s\tt\t1\ts^,^r^,^t"


def test_params_of_a_folder(spark, tmp_path):
    at = f"file://{tmp_path}/made"
    assert not sinks.same_params(spark, at, {"a": 1})
    sinks.write_params(spark, at, {"a": 1, "b": 2})
    assert sinks.same_params(spark, at, {"a": 1, "b": 2}) and sinks.same_params(spark, at, {"a": 1, "b": 3}, ["b"])
    with pytest.raises(ValueError, match="other parameters"):
        sinks.same_params(spark, at, {"a": 2, "b": 2})
    spark.range(1).write.parquet(f"{at}2/half")
    with pytest.raises(ValueError, match="not finished"):
        sinks.same_params(spark, f"{at}2", {})


def test_ranked_lines(spark, tmp_path):
    lines = lambda f: [r[0] for r in sorted(spark.read.text(f"{tmp_path}/{f}").collect())]
    names = spark.createDataFrame([("a", "Ann")], "n string, name string")
    sinks.write_node_scores(spark.createDataFrame([("a", 0.5), ("b", 2.0)], "source string, score double"), f"{tmp_path}/n", names)
    sinks.write_path_counts(spark.createDataFrame([("-p-", 2), ("-q-", 5)], "path string, n_pairs long"), f"{tmp_path}/c")
    sinks.write_paths(spark.createDataFrame([("-p-",), ("-p-",)], "path string"), f"{tmp_path}/s")
    sinks.write_vectors(spark.createDataFrame([("r", [1.0, -2.5])], "r string, v array<double>"), f"{tmp_path}/v")
    sinks.write_similarities(spark.createDataFrame([("r", "q", 0.25)], "r1 string, r2 string, weight double"), f"{tmp_path}/w")
    sinks.write_instance_paths(spark.createDataFrame([("a", "b", "-p-", 3.0)], "source string, target string, path string, visits double"), f"{tmp_path}/i")
    assert lines("n") == ["Ann\t0.5", "b\t2.0"] and lines("c") == ["-p-\t2", "-q-\t5"] and lines("s") == ["-p-"]
    assert lines("v") == ["r\t1.0\t-2.5"] and lines("w") == ["r\tq\t0.25"] and lines("i") == ["a\tb\t-p-\t3.0"]


def test_scorer(spark, tmp_path):
    p = scorer.predictions(spark.createDataFrame([("a\tb\t2.0\t*",), ("a\tc\t1.0\t^",), ("a\td",), ("",)], "value string"))
    assert sorted(map(tuple, p.collect())) == [("a", "b", 2.0, False), ("a", "c", 1.0, True)]
    t = scorer.positives(spark.createDataFrame([("a\tb",), ("a\tc\t-1",), ("d\te\t1",)], "value string"))
    assert sorted(map(tuple, t.collect())) == [("a", "b"), ("d", "e")]
    one = {f"r{i}": p.withColumn("relation", F.lit(f"r{i}")) for i in range(3)}
    scores = one["r0"].unionAll(one["r1"]).unionAll(one["r2"])
    tests = scores.select("relation").distinct().crossJoin(t)
    worse = scores.withColumn("target", F.lit("z"))
    got = scorer.score({"good": (scores, tests), "bad": (worse, tests)})
    value = {(r["experiment"], r["relation"], r["metric"]): r["value"] for r in got.collect()}
    assert value["good", "r1", "ap"] == 0.5 and value["bad", "r1", "ap"] == 0 and value["good", scorer.ALL, "map"] == 0.5
    assert scorer.order(got) == ["good", "bad"]
    # all of 8 sign flips but the two with equal signs are smaller
    assert scorer.significance(got).first()["p"] == 0.25
    text = scorer.main(spark, {"good": (scores, tests)}, f"{tmp_path}/m")
    assert "MMRR+" in text and "( 1) good" in text and "Per-relation ap" in text
    again = scorer.merged(got.where("experiment = 'bad'"), sinks.read_metrics(spark, f"{tmp_path}/m"))
    assert {r[0] for r in again.select("experiment").distinct().collect()} == {"good", "bad"}
    assert scorer.kept(["a/x", "b/y"], ["x"]) == ["a/x"] and scorer.kept(["a"]) == ["a"]
    with pytest.raises(ValueError):
        scorer.score({}, None)
    wide_table = scorer.by_relation(got).collect()
    assert [r["relation"] for r in wide_table] == ["r0", "r1", "r2"] and wide_table[0]["good"] == 0.5


def test_ingest(spark, tmp_path):
    e = edges(spark, [("x", "/r/one", "y"), ("x", ingest.TYPE, "/c/a"), ("y", ingest.TYPE, "/c/a")])
    ingest.write(e, spark.createDataFrame([("inverse\t/r/one\t/r/two",), ("argtypes\t/r/one\t/c/a\t/c/b",)], "value string"), f"{tmp_path}/m")
    assert sorted(map(tuple, ingest.read_members(spark, f"{tmp_path}/m").collect())) == [("_c_a", "x"), ("_c_a", "y")]
    assert [tuple(r) for r in ingest.read_instances(spark, f"{tmp_path}/m").collect()] == [("_r_one", "x", "y", 1)]
    read = lambda f: [r[0] for r in spark.read.text(f"{tmp_path}/m/{f}.tsv").collect()]
    assert (read("inverses"), read("domains"), read("ranges")) == (["/r/one\t/r/two"], ["/r/one\t/c/a"], ["/r/one\t/c/b"])


def features(spark, seed=4, n=60, d=5):
    rng = np.random.default_rng(seed)
    x = (rng.random((n, d)) < 0.5) * rng.normal(size=(n, d)).round(2)
    y = np.where(x @ rng.normal(size=d) + rng.normal(size=n) > 0, 1, -1)
    rows = [("r", i, int(y[i]), f"f{j}", float(x[i, j])) for i in range(n) for j in range(d) if x[i, j]] + [("r", i, int(y[i]), "one", 1.0) for i in range(n)]
    return spark.createDataFrame(rows, "relation string, iid long, label int, feature string, value double"), np.hstack([x, np.ones((n, 1))]), (y > 0).astype(float)


@pytest.mark.parametrize("l2", [0.5, 3.0])
def test_logistic_reaches_its_optimum(spark, l2):
    """Against plain gradient steps; the cluster's way and a task's give the same weights."""
    f, x, y = features(spark)
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(60_000):
        e = 1 / (1 + np.exp(-(x @ w + b))) - y
        w, b = w - 0.01 * (x.T @ e + 2 * l2 * w), b - 0.01 * e.sum()
    want = {f"f{j}": w[j] for j in range(5)} | {"one": w[5]}
    for values in (10**6, 10):
        got = {r["feature"]: r["weight"] for r in models.logistic(f, 0.0, l2, 2000, values).collect()}
        assert all(math.isclose(got.get(k, 0.0), v, abs_tol=2e-3) for k, v in want.items()), (values, got, want)


def test_l1_weights_vanish(spark):
    f, _, _ = features(spark)
    one, two = ({r["feature"]: r["weight"] for r in models.logistic(f, 4.0, 0.5, 3000, n).collect()} for n in (10**6, 10))
    assert set(one) == set(two) and len(one) < 6 and all(abs(one[k] - two[k]) < 2e-3 for k in one)


def test_linear_svm_reaches_its_optimum(spark):
    """Its loss is no higher than that of subgradient steps."""
    f, x, y = features(spark)
    sign = 2 * y - 1
    loss = lambda w: 0.5 * w @ w + np.maximum(0, 1 - sign * (x @ w)).sum()
    got = {r["feature"]: r["weight"] for r in models.linear_svm(f, 1.0, 400).collect()}
    mine = np.array([got[f"f{j}"] for j in range(5)] + [got["one"]])
    w = np.zeros(x.shape[1])
    best = loss(w)
    for k in range(1, 20_000):
        on = sign * (x @ w) < 1
        w = w - (1 / (k + 10)) * (w - (x[on] * sign[on, None]).sum(0))
        best = min(best, loss(w))
    assert loss(mine) <= best + 1e-3


def test_large_sets_of_vectors_raise(spark, monkeypatch):
    monkeypatch.setattr(models, "MOST_VECTORS", 2)
    with pytest.raises(ValueError, match="similar_hashed"):
        models.similar_pairs(spark.createDataFrame([(str(i), [1.0, float(i)]) for i in range(3)], "r string, v array<double>"), 0.0)


def test_specifications_are_strict(spark):
    fine = {"type": "pra", "path finder": {"walks per source": 5}, "path selector": {"name": "MostFrequentPathTypeSelector"}}
    assert experiment.checked(fine) == "pra" and experiment.checked({"type": "subgraphs", "feature extractors": ["PraFeatureExtractor"]}) == "subgraphs"
    for bad in ({"type": "other"}, {"pathfinder": {}}, {**fine, "path finder": {"path type factory": {}}}, {**fine, "path selector": {"name": "other"}}, {"type": "subgraphs", "path selector": {}}, {"type": "subgraphs", "feature extractors": [{"name": "PraFeatureExtractor", "x": 1}]}):
        with pytest.raises(ValueError):
            experiment.checked(bad)


def test_walk_counts(spark):
    """One pair that an edge joins, and a node between: squares and products, or cubes of all."""
    kinds = "iid int, start string, node string, path array<string>, back array<string>, visits double"
    a = spark.createDataFrame([(1, "s", "t", ["e"], ["_e"], 3.0), (1, "s", "m", ["f"], ["_f"], 2.0)], kinds)
    b = spark.createDataFrame([(1, "t", "s", ["_e"], ["e"], 4.0), (1, "t", "m", ["g"], ["_g"], 5.0)], kinds)
    inst = spark.createDataFrame([(1, "s", "t")], "iid int, source string, target string")
    got = {tuple(r["path"]): r["n_pairs"] for r in walks.direct_and_paired(a, b, inst).collect()}
    assert got == {("e",): 9.0 + 16.0, ("f", "_g"): 10.0}
    got = {tuple(r["path"]): r["n_pairs"] for r in walks.direct_and_paired(a, b, inst, "everything").collect()}
    assert got == {("e",): 27.0 + 64.0, ("f", "_g"): 10.0}
    sub = {(r["start"], r["node"], tuple(r["path"])) for r in walks.local_subgraphs(a, b).collect()}
    assert sub == {("s", "t", ("e",)), ("s", "m", ("f",)), ("t", "s", ("_e",)), ("t", "m", ("g",)), ("s", "t", ("f", "_g"))}
    with pytest.raises(ValueError):
        walks.direct_and_paired(a, b, inst, "some")


@pytest.mark.parametrize("name", ["split_with_negatives", "potential_predictions", "feat_pra_with_nodes", "walk_counts_everything", "experiment_nodes", "sink_edges", "sink_metrics"])
def test_against_sql(spark, name):
    import os

    import duckdb

    from graphweft.plans import oracle_wide

    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    if not os.path.isdir(sf):
        pytest.skip("driver's tables")
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    got, want = wide.QUERIES[name](spark, sf).toPandas(), con.execute(oracle_wide.ORACLE_SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda d: sorted(str(tuple(round(float(v), 6) if isinstance(v, float) else v for v in r)) for r in d[cols].itertuples(index=False))
    assert rows(got) == rows(want)


def test_all_sign_flips_are_tried(spark):
    d = [0.3, -0.1, 0.25, 0.05]
    p = scorer.scoring.permutation_test(spark.createDataFrame([(f"r{i}", x) for i, x in enumerate(d)], "relation string, d double"))
    flips = [abs(sum(s * x for s, x in zip(signs, d))) for signs in itertools.product((1, -1), repeat=4)]
    assert p == np.mean([x >= abs(sum(d)) - 1e-12 for x in flips])


def test_likelihood_counts_and_names(spark):
    rows = [("r", 1, 1, "a", 1.0), ("r", 1, 1, "b", 2.0), ("r", 2, -1, "a", 1.0), ("r", 3, None, "b", 1.0)]
    f = spark.createDataFrame(rows, "relation string, iid long, label int, feature string, value double")
    w = spark.createDataFrame([("r", "a", 0.5), ("r", "b", -1.0)], models.WEIGHTS)
    p = lambda z: 1 / (1 + math.exp(-z))
    got = models.log_likelihood(f.where("label is not null"), w).first()["value"]
    assert math.isclose(got, (math.log(p(0.5 - 2.0)) + math.log(1 - p(0.5))) / 2)
    assert tuple(models.feature_counts(f).first()) == ("r", 2, 1, 1, 1.0)
    from graphweft.operators import features as fx

    assert sorted(map(tuple, fx.names(f).collect())) == [(1, "a"), (2, "b")]
    kept = models.nonzero(spark.createDataFrame([("a",), ("c",)], "path string"), w)
    assert [r[0] for r in kept.collect()] == ["a"]


def test_runner(spark, tmp_path):
    """A graph, a split with negatives, embeddings, similarities and denser matrices, made once; then an experiment over them."""
    from graphweft.plans import runner

    base = f"file://{tmp_path}"
    rows = [(f"s{i}", f"m{i}", "r1") for i in range(16)] + [(f"m{i}", f"t{(i + k) % 4}", "r2") for i in range(16) for k in range(2)] + [(f"s{i}", f"t{i % 4}", "goal") for i in range(8)]
    (tmp_path / "kb.tsv").write_text("".join("\t".join(r) + "\n" for r in rows))
    dump = edges(spark, [(f"s{i}", "goal", f"t{i % 4}") for i in range(16)] + [(f"s{i}", ingest.TYPE, "left") for i in range(16)] + [(f"t{i}", ingest.TYPE, "right") for i in range(4)])
    ingest.write(dump, spark.createDataFrame([("argtypes\tgoal\tleft\tright",)], "value string"), f"{base}/relation_metadata/meta")
    made = {"name": "g", "relation sets": [{"relation file": f"{base}/kb.tsv", "is kb": True}], "output matrices": True}
    parts = {"name": "halves", "type": "fixed split from relation metadata", "relation metadata": "meta", "graph": "g", "relations": ["goal"], "percent training": 0.5, "negative instances": {"negative to positive ratio": 2, "ppr computer": {"num steps": 3}}}
    similar = {"name": "near", "embeddings": {"name": "e", "graph": "g", "dims": 2}, "threshold": -1.0, "num_hashes": 8, "hash_size": 1}
    assert runner.graph(spark, made, base).count() == 56 and runner.graph(spark, made, base).count() == 56
    assert runner.embeddings(spark, similar["embeddings"], base).count() >= 2
    assert {(r["r1"], r["r1"]) for r in runner.similarities(spark, similar, base).collect()} <= {(r["r1"], r["r2"]) for r in runner.similarities(spark, similar, base).collect()}
    rows = runner.split(spark, parts, base)
    assert rows.where("label > 0").count() == 16 and rows.where("label < 0").count() > 4 and rows.where("label < 0 and not startswith(source, 's')").count() == 0
    dense = runner.denser(spark, {"name": "d", "similarity matrix": similar, "split": "halves"}, "g", base)
    assert dense.where("value is null").count() == 0 and dense.count() > 0
    spec = {"graph": made, "split": parts, "operation": {"type": "no op"}}
    assert runner.run(spark, spec, base, "none") is None
    (tmp_path / "experiment_specs").mkdir()
    (tmp_path / "param_files").mkdir()
    spec["operation"] = {"type": "train and test", "features": {"type": "subgraphs", "path finder": {"number of steps": 1}}, "learning": {"l2 weight": 0.1}}
    (tmp_path / "experiment_specs" / "one.json").write_text(json.dumps(spec))
    assert runner.main(spark, base, ["one"]) == ["one"] and runner.main(spark, base) == []
    got = experiment.read_scores(spark, f"{base}/results/one").collect()
    assert got and all(r["score"] is not None for r in got)
    with pytest.raises(ValueError, match="other parameters"):
        runner.graph(spark, {**made, "deduplicate edges": True}, base)
    add = {"name": "more", "type": "add negatives to split", "relation metadata": "meta", "graph": "g", "from split": "halves", "generate negatives for": "test"}
    assert runner.split(spark, add, base).where("fold = 'training'").count() == rows.where("fold = 'training'").count()


@pytest.mark.parametrize("policy", ["paired-only", "everything"])
def test_counts_from_one_of_all_twins(spark, policy):
    """Twins: c0 to c13, c11 to c13 of another hub; c12 is a source and a target, one pair has the same ends, and one comes twice."""
    e = [(f"c{i}", "in", "x" if i < 11 else "y") for i in range(14)] + [("x", "of", "r"), ("y", "of", "r"), ("c20", "in", "x"), ("c20", "in", "y")]
    adj = graph.both_ways(spark.createDataFrame(e, "s string, r string, t string"))
    inst = [(i, f"c{i}", "r") for i in range(14)] + [(20, "c20", "r"), (21, "c3", "c12"), (22, "c11", "c12"), (23, "c13", "c12"), (24, "c5", "c5"), (25, "c5", "r")]
    inst = spark.createDataFrame(inst, "iid long, source string, target string")
    found = [walks.found_paths(inst, side, adj, 100, 3) for side in ("source", "target")]
    rows = lambda df: {tuple(r["path"]): round(r["n_pairs"], 6) for r in df.collect()}
    want = rows(walks.direct_and_paired(*found, inst, policy))
    assert len(want) > 5 and rows(walks.pair_counts(inst, adj, policy, 100, 3)) == want
    assert walks.alike(inst, adj).count() < inst.count()


@pytest.mark.parametrize("name", ["walk_counts_paired", "walk_counts_everything", "walk_subgraphs", "path_find_expected"])
def test_walks_are_stored_for_one_of_all_twins(spark, name):
    import __spark_entry__

    tables.clear(spark)
    assert __spark_entry__.queries()[name](spark, "/root/testdata/sf0.01").count()
    found = [x for x in (spark.read.parquet(x) for x in tables._STORED) if {"iid", "node"} <= set(x.columns)]
    customers = spark.read.parquet("/root/testdata/sf0.01/customer.parquet").count()
    assert found and max(x.select("iid").distinct().count() for x in found) < customers / 2


@pytest.mark.parametrize("allowed", [None, [f"c{i}" for i in range(2, 9)] + ["x", "r"]])
def test_ranks_of_twins_are_those_of_each_start(spark, allowed):
    """What each start draws from, with walks from one of all twins, against walks from each; few of the best, so twins fall out."""
    e = [(f"c{i}", "in", "x" if i < 11 else "y") for i in range(14)] + [("x", "of", "r"), ("y", "of", "r"), ("c20", "in", "x"), ("c20", "in", "y")]
    adj = graph.both_ways(spark.createDataFrame(e, "s string, r string, t string"))
    starts = spark.createDataFrame([(f"c{i}",) for i in [*range(14), 20]] + [("r",), ("gone",)], "n string")
    fits = None if allowed is None else spark.createDataFrame([(x,) for x in allowed], "n string")
    for most in (3, 100):
        want = datasets._drawable(walks.rank_shares(starts, adj, 3, 0.15, fits), most)
        lists, keys = datasets._ranks(starts, adj, 3, 0.15, fits, most)
        rows = lambda df: {r["n"]: (r["upto"], r["total"]) for r in df.collect()}
        assert rows(keys.join(lists, "key")) == rows(want.withColumnRenamed("start", "n"))


def test_ranks_of_negatives_are_stored_for_one_of_all_twins(spark):
    import __spark_entry__

    tables.clear(spark)
    assert __spark_entry__.queries()["negatives_sampled"](spark, "/root/testdata/sf0.001").count()
    ranks = [spark.read.parquet(x) for x in tables._STORED if "/ranks-" in x]
    assert ranks and all(x.select("start").distinct().count() <= 25 for x in ranks)


def test_buckets_are_dealt_in_parts(spark, monkeypatch):
    monkeypatch.setattr(tables, "DEALT", 1)
    df = spark.range(500).select(F.concat(F.lit("n"), (F.col("id") % 90).cast("string")).alias("n"), "id")
    out = tables.bucketed(df.unionAll(df.select(F.lit(None).cast("string"), "id").limit(3)), "n", "parts")
    assert out.exceptAll(df).count() == 3 and df.exceptAll(out).count() == 0
    names = [f.rsplit("_", 1)[-1] for f in out.inputFiles()]
    assert len(names) == len(set(names))  # a bucket is written by one part
    tables.forget(out)
    assert not spark.catalog.tableExists(out.stored_at[0])


@pytest.mark.parametrize("end", [True, False])
def test_adjacency_goes_once_the_parts_are_stored(spark, end):
    from graphweft.plans import catalogue

    tables.clear(spark)
    shared, single = catalogue.parts(spark, "/root/testdata/sf0.001", end)
    assert shared.count() and single.count() and not tables._TABLES


def test_keys_are_counted_in_parts(spark):
    shared = spark.createDataFrame([("a", "p", x, 2) for x in "uvw"] * 2 + [("b", "p", "u", 3)], "start string, path string, node string, times long")
    single = spark.createDataFrame([("a", "p", "u", 1), ("a", "p", "x", 1), ("a", "p", "x", 2), ("c", "q", "u", 9)], "start string, path string, node string, iid long")
    want = [("p", "u", 5), ("p", "v", 2), ("p", "w", 2), ("p", "x", 2), ("q", "u", 1)]
    before = len(tables._STORED)
    for many in (False, True):
        assert sorted(map(tuple, paths.shared_counts(shared, single, ["path", "node"], many).collect())) == want
    assert len(tables._STORED) == before + paths.PASSES


def test_trainers_get_the_features_of_like_rows_once(spark):
    rng = np.random.default_rng(3)
    x = (rng.random((60, 4)) < 0.5).astype(float)
    x[:, 3] = 1
    y = np.where(rng.random(60) < 0.3 + 0.4 * x[:, 0], 1, -1)
    f = spark.createDataFrame([("r", i, int(y[i]), f"f{j}", 1.0) for i in range(60) for j in range(4) if x[i, j]], "relation string, iid long, label int, feature string, value double")
    rows, kinds = models._kinds(f)
    assert rows.count() == 60 and kinds.count() == int(np.unique(x, axis=0).sum())
    w, last = np.zeros(4), np.zeros(4)
    for k in range(5):
        for a, b in zip(x, y):
            on = a > 0
            move = 1 / (1 + k) * ((b > 0) - 1 / (1 + np.exp(-np.clip(w @ a, -20, 20)))) * a + 0.5 * last
            w[on] += move[on]
            last[on] = move[on]
    got = {r["feature"]: r["weight"] for r in models.online(f).collect()}
    assert np.allclose([got[f"f{j}"] for j in range(4)], w)


def test_experiments_store_no_row_for_each_pair_and_node(spark, monkeypatch):
    split = spark.createDataFrame([("likes", fold, f"a{i}", f"b{i % 3}", 1 if i % 2 else -1) for i in range(8) for fold in ("training", "testing")], "relation string, fold string, source string, target string, label int")
    e = edges(spark, [(f"a{i}", "in", f"x{i % 4}") for i in range(8)] + [(f"x{i}", "of", f"b{i % 3}") for i in range(4)] + [("a1", "likes", "b1"), ("a1", "likes", "b2"), ("b0", "in", "a0")])
    extractors = ["PraFeatureExtractor", "OneSidedPathOnlyFeatureExtractor"]
    inst = split.where("fold = 'testing'").select(F.xxhash64("source", "target", "label").alias("iid"), "source", "target", "label")
    sub = paths.pair_subgraph(inst, graph.both_ways(e), 2, ["likes"])
    from graphweft.operators import features

    want = features.pra(sub, inst).unionAll(features.one_sided(sub, inst, False)).distinct()
    monkeypatch.setattr(paths, "pair_subgraph", None)
    got = experiment.subgraph_features(inst, graph.both_ways(e), {"feature extractors": extractors}, ["likes"]).select("iid", "feature")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("nodes", [True, False])
def test_tables_of_the_adjacency_go_one_by_one(spark, monkeypatch, nodes):
    """Parts of the subgraphs over an adjacency in several tables, each gone before the last hop goes over the next."""
    e = [(f"a{i}", "in", f"x{i % 5}") for i in range(30)] + [(f"x{i}", "of", f"b{i % 3}") for i in range(5)] + [(f"a{i}", "likes", f"b{i % 3}") for i in range(30)]
    inst = spark.createDataFrame([(i, f"a{i}", f"b{(i + k) % 3}") for k in (0, 1) for i in range(30)], "iid long, source string, target string").withColumn("iid", F.monotonically_increasing_id())
    inst = spark.createDataFrame(inst.collect(), inst.schema)
    adj = graph.both_ways(edges(spark, e))
    rows = lambda x: sorted({tuple(map(str, r)) for y in x for r in y.collect()})
    want = rows(paths.pair_parts(inst, adj, 2, ["likes"], nodes))
    monkeypatch.setattr(tables, "DEALT", 1)
    got = tables.dealt(graph.capped(adj, 8), "n", "adjacency")
    assert len(got) == 4 and sum(x.count() for x in got) == graph.capped(adj, 8).count()
    left, keep = [], paths.stored
    monkeypatch.setattr(paths, "stored", lambda df, name: (name == "from-sources" and left.append(len(tables._TABLES)), keep(df, name))[1])
    tables.clear(spark)
    assert rows(paths.pair_parts(inst, tables.dealt(adj, "n", "adjacency"), 2, ["likes"], nodes)) == want
    assert left == [4, 4, 3, 2, 1] and not tables._TABLES


@pytest.mark.parametrize("nodes", [True, False])
@pytest.mark.parametrize("steps", [1, 2])
def test_large_adjacency_is_never_stored(spark, monkeypatch, nodes, steps):
    """Parts of the subgraphs of a large graph without a table of its edges, in several groups of nodes, with hubs and held-out edges."""
    e = [(f"a{i}", "in", f"x{i % 5}") for i in range(30)] + [(f"x{i}", "of", f"b{i % 3}") for i in range(5)] + [(f"a{i}", "likes", f"b{i % 3}") for i in range(30)]
    e += [("a1", "in", "x3"), ("a1", "in", "x3"), ("hub", "of", "b1"), *[("hub", "in", f"a{i}") for i in range(30)]]
    inst = spark.createDataFrame([(i + 100 * k, f"a{i}", f"b{(i + k) % 3}") for k in (0, 1) for i in range(30)], "iid long, source string, target string")
    adj = graph.both_ways(edges(spark, e))

    def found(a):
        shared, single = paths.pair_parts(inst, a, steps, ["likes"], nodes)
        node = F.col("node") if nodes else F.lit(None)  # of shared rows, which lose theirs but where paths meet
        return sorted({tuple(map(str, r)) for x in (shared.withColumn("node", node), single) for r in x.collect()})

    want = found(graph.capped(adj, 8))
    kept, keep = [], paths.stored
    monkeypatch.setattr(paths, "stored", lambda df, name: (kept.append(name), keep(df, name))[1])
    monkeypatch.setattr(graph, "ROWS", 5)
    monkeypatch.setattr(tables, "DEALT", 1)
    tables.clear(spark)
    assert found(graph.searched(adj, 8)) == want
    assert not tables._TABLES and kept.count("from-sources") == (1 if steps == 1 else steps - 1 + graph.PARTS)
    assert not [x for x in tables._STORED if "/hop-" in x or "/first-" in x]


def test_filter_of_keys(spark):
    """Every key passes, few others do, and none is lost where the filter is full."""
    keys, rows = (spark.range(a, b).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("k")) for a, b in ((0, 20_000), (10_000, 60_000)))
    for monkey in ((16, 26), (16, 16)):
        tables.BITS, before = monkey, tables.BITS
        try:
            got = {r[0] for r in tables.may_hold(rows, "k", tables.key_filter(keys, "k")).collect()}
        finally:
            tables.BITS = before
        assert {f"k{i}" for i in range(10_000, 20_000)} <= got
        assert len(got) < 10_000 + (40_000 * 0.15 if monkey == (16, 26) else 40_001)


def test_negatives_are_drawn_in_parts(spark, monkeypatch):
    """Parts of the pairs give what all of them at once do, and none of the draws is shuffled to find equal ones."""
    adj = graph.both_ways(edges(spark, [(f"s{i}", "in", f"t{i % 3}") for i in range(40)] + [(f"t{i}", "of", "u") for i in range(3)]))
    pos = spark.createDataFrame([(f"s{i}", f"t{i % 3}") for i in range(25)], "source string, target string")
    targets = spark.createDataFrame([(f"t{i}",) for i in range(3)], "n string")
    draw = lambda: sorted(map(tuple, datasets.ranked_negatives(pos, adj, targets=targets, ratio=2, steps=2).collect()))
    want, kept, keep = draw(), [], datasets.stored
    monkeypatch.setattr(datasets, "stored", lambda df, name: (kept.append((name, df)), keep(df, name))[1])
    monkeypatch.setattr(datasets, "DRAWS", 100, raising=False)
    assert draw() == want and len(want) > 25
    drawn = [df for name, df in kept if name == "drawn"]
    assert len(drawn) == 5 and not any("min(attempt" in x._jdf.queryExecution().toString() for x in drawn)


def test_negatives_look_through_the_graph_once(spark, monkeypatch):
    """Which instances and members are in the graph is stored before walks begin, not found again for each of their tables."""
    e = edges(spark, [(f"s{i}", "in", f"t{i % 3}") for i in range(12)])
    split = spark.createDataFrame([("in", "training" if i < 8 else "testing", f"s{i}", f"t{i % 3}", 1) for i in range(12)], "relation string, fold string, source string, target string, label int")
    of = spark.createDataFrame([("in", "t")], "a string, b string")
    cats = spark.createDataFrame([("t", f"t{i}") for i in range(3)], "a string, b string")
    seen = []
    monkeypatch.setattr(datasets, "ranked_negatives", lambda own, adj, others, sources=None, targets=None, **o: (seen.append((own, targets)), own.select("source", "target", F.lit(-1).alias("label")))[1])
    assert datasets.with_negatives(split, e, graph.both_ways(e), "test", ranges=of, categories=cats).count() == 16
    for x in seen[0]:
        assert "Join" not in x._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("steps, restart, swap", [(1, 0.0, False), (2, 0.0, False), (2, 0.3, True), (3, 0.2, False)])
def test_meeting_walks_are_those_of_each_pair(spark, steps, restart, swap):
    """Counts of paths from walks that begin once at each end, against walks of each pair; pairs that held-out edges join, parallel edges
    and loops, a pair of one node, one that comes twice, and one that is not in the graph."""
    rng = np.random.default_rng(4)
    e = [(f"a{i}", "in", f"x{i % 3}") for i in range(12)] + [(f"x{i}", "of", f"b{i % 2}") for i in range(3)] + [(f"a{i}", "likes", f"b{i % 2}") for i in range(9)]
    e += [("b0", "likes", "a2"), ("a1", "in", "x1"), ("a1", "likes", "b1"), ("a3", "in", "a3"), ("a4", "in", "b0")] + [(f"a{rng.integers(12)}", "knows", f"a{rng.integers(12)}") for _ in range(15)]
    pairs = [(f"a{i}", f"b{(i + k) % 2}") for i in range(12) for k in (0, 1)] + [("a5", "a5"), ("a1", "b1"), ("a1", "a2"), ("gone", "b0")]
    inst = spark.createDataFrame([(i, *(p[::-1] if swap else p)) for i, p in enumerate(pairs)], "iid long, source string, target string")
    adj = graph.both_ways(edges(spark, e))
    rows = lambda df: {tuple(r["path"]): r["n_pairs"] for r in df.collect()}
    want = rows(walks.direct_and_paired(*[walks.found_paths(inst, side, adj, 100, steps, restart, ["likes"]) for side in ("source", "target")], inst))
    got = rows(walks.direct_and_paired(*walks.meeting_paths(inst, walks.counted(adj), 100, steps, restart, ["likes"]), inst))
    assert len(want) > 2 and set(got) == set(want) and all(abs(got[k] - want[k]) <= 1e-9 * want[k] for k in want)


def test_walks_of_experiments_store_no_row_for_each_pair_and_node(spark):
    import __spark_entry__

    tables.clear(spark)
    assert __spark_entry__.queries()["experiment_walks"](spark, "/root/testdata/sf0.001").count()
    found = [x for x in (spark.read.parquet(x) for x in tables._STORED) if {"iid", "node"} <= set(x.columns)]
    customers = spark.read.parquet("/root/testdata/sf0.001/customer.parquet").count()
    assert found and max(x.count() for x in found) < 40 * customers
