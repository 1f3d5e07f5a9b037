"""Runs specifications below a base folder: what they need is built once, in folders that later ones use again."""

from __future__ import annotations

import logging
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import stored
from ..operators import datasets, models, vectors
from ..operators import graph as g
from ..sources import ingest, sinks, specs, synthetic, triples
from ..sources.specs import known_keys
from . import experiment

log = logging.getLogger("graphweft")

NEGATIVE = ["ppr computer", "negative to positive ratio", "max potential predictions"]
RANKS = ["type", "reset probability", "walks per source", "num steps", "num iterations", "log level"]
SPLIT = ["name", "type", "relation metadata", "graph", "percent training", "negative instances", "from split", "relations", "generate negatives for", "node or node pair"]


def place(spec: object, base: str, kind: str) -> str:
    """An absolute path, or a name below the base's folder for that kind of thing."""
    name = spec.get("name") if isinstance(spec, dict) else spec
    if not isinstance(name, str) or not name:
        raise ValueError(f"no name in {kind}: {spec!r}")
    return name.rstrip("/") if name.startswith("/") or "://" in name else f"{base.rstrip('/')}/{kind}/{name}"


def read_graph(spark: SparkSession, folder: str) -> DataFrame:
    """Edges (s, r, t) by name of a written graph."""
    x = sinks.read_edges(spark, folder)
    nodes, relations = (spark.read.csv(f"{folder}/{f}", sep="\t", schema="id int, name string") for f in ("node_dict.tsv", "edge_dict.tsv"))
    for c, of in (("s", nodes), ("t", nodes), ("r", relations)):
        x = x.join(of.select(F.col("id").alias(c), F.col("name").alias(f"{c}__")), c).drop(c)
    return x.select(F.col("s__").alias("s"), F.col("r__").alias("r"), F.col("t__").alias("t"))


def graph(spark: SparkSession, spec: object, base: str) -> DataFrame:
    """A graph by path or name, or by an object that says how it is made, if there is none of that name yet. The field denser matrices
    doesn't count when an object is compared with the one that made the folder."""
    folder = place(spec, base, "graphs")
    if isinstance(spec, dict) and "relation sets" in spec:
        made = {k: v for k, v in spec.items() if k != "denser matrices"}
        if not sinks.same_params(spark, folder, made):
            e = stored(experiment.graph(spark, made), "edges")
            sinks.write_graph(e, folder, made.get("output binary file", False), made.get("output plain text file", True), made.get("shard plain text graph", False), made.get("max matrix file size", 1_000_000) if made.get("output matrices", False) else 0)
            for x in made["relation sets"]:
                if x.get("type") == "generated":
                    p = x["generation params"]
                    sinks.write_generated(*synthetic.generated(spark, experiment.plan(p)), f"{folder}/generated/{p.get('name', 'data')}")
            sinks.write_params(spark, folder, made)
    return read_graph(spark, folder)


def embeddings(spark: SparkSession, spec: object, base: str) -> DataFrame:
    """Vectors (r, v) of a graph's relations: by path or name, or made once by the keys name, graph and dims."""
    folder = place(spec, base, "embeddings")
    if isinstance(spec, dict) and "dims" in spec:
        known_keys(spec, ["name", "graph", "dims"], "embeddings")
        if not sinks.same_params(spark, folder, spec):
            sinks.write_vectors(vectors.decomposed(graph(spark, spec["graph"], base), spec["dims"]), f"{folder}/embeddings.tsv")
            sinks.write_params(spark, folder, spec)
    return triples.vectors(spark, f"{folder}/embeddings.tsv")


def similarities(spark: SparkSession, spec: dict, base: str) -> DataFrame:
    """(r1, r2, weight) with the diagonal, made once below the folder of the embeddings."""
    known_keys(spec, ["name", "embeddings", "threshold", "num_hashes", "hash_size", "entries per vector", "upper threshold", "to ignore"], "similarity matrix")
    v = embeddings(spark, spec["embeddings"], base)
    folder = f"{place(spec['embeddings'], base, 'embeddings')}/{spec['name']}"
    if "threshold" in spec and not sinks.same_params(spark, folder, spec):
        ignore = [r[0] for r in spark.read.text(spec["to ignore"]).collect()] if "to ignore" in spec else []  # relations
        pairs = vectors.similar_hashed(v, spec["threshold"], spec.get("upper threshold", 0.99999), spec["num_hashes"], spec["hash_size"], spec.get("entries per vector", -1), ignore)
        sinks.write_similarities(pairs, f"{folder}/matrix.tsv")
        sinks.write_params(spark, folder, spec)
    return triples.similarities(spark, f"{folder}/matrix.tsv")


def denser(spark: SparkSession, spec: dict, graph_spec: object, base: str, most: int = 100_000) -> DataFrame:
    """Entries (file, r, s, t, value) of a densified graph, made once below its folder; without the test edges of a split, if named."""
    known_keys(spec, ["name", "similarity matrix", "split"], "denser matrices")
    folder = f"{place(graph_spec, base, 'graphs')}/{spec['name']}"
    if not sinks.same_params(spark, folder, spec):
        e = graph(spark, graph_spec, base)
        if "split" in spec:
            e = g.without_tests(e, sinks.read_split(spark, spec["split"], base))
        dense = stored(models.densify(e, similarities(spark, spec["similarity matrix"], base)), "dense")
        names = [r[0] for r in dense.select("r").distinct().orderBy("r").collect()]  # a vocabulary
        ids = spark.createDataFrame([(i, r) for i, r in enumerate(names, 1)], "id long, name string")
        files = g.matrix_files(dense.select("s", "r", "t"), ids, most).select("file", "r").distinct()
        sinks.write_matrices(dense.join(F.broadcast(files), "r").select("file", "r", "s", "t", "value"), f"{folder}/matrices")  # a row a relation
        sinks.write_params(spark, folder, spec)
    return sinks.read_matrices(spark, f"{folder}/matrices")


def _negative(spec: dict, adj: DataFrame) -> dict:
    known_keys(spec, NEGATIVE, "negative instances")
    ranks = spec.get("ppr computer", {})
    known_keys(ranks, RANKS, "ppr computer")
    return {"adj": adj, "ratio": spec.get("negative to positive ratio", 3), "steps": ranks.get("num steps", ranks.get("num iterations", 4)), "restart": ranks.get("reset probability", 0.15)}


def _metadata(spark: SparkSession, folder: str) -> dict:
    """Tables of a metadata folder, those that it has."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    has = lambda name: (p := fs.Path(f"{folder}/{name}")).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    out = {name: triples.metadata(spark, f"{folder}/{name}.tsv") if has(f"{name}.tsv") else None for name in ("domains", "ranges")}
    if has("category_instances"):
        out["categories"] = ingest.read_members(spark, folder)
        for name in ("domains", "ranges"):
            out[name] = out[name] if out[name] is None else out[name].withColumn("b", sinks.segment(F.col("b")))
    return out


def split(spark: SparkSession, spec: object, base: str) -> DataFrame:
    """A split by path or name, or made once: from a metadata folder, or from another split with negatives."""
    folder = sinks.split_folder(spec, base)
    if isinstance(spec, dict) and "type" in spec or isinstance(spec, dict) and "percent training" in spec:
        known_keys(spec, SPLIT, "split")
        kind = spec.get("type", "fixed split from relation metadata")
        if not sinks.same_params(spark, folder, spec):
            meta = place(spec["relation metadata"], base, "relation_metadata")
            e = graph(spark, spec["graph"], base) if "graph" in spec else None
            negative = _negative(spec["negative instances"], g.both_ways(e)) if "negative instances" in spec else None
            tables = _metadata(spark, meta)
            if kind == "fixed split from relation metadata":
                names = spark.createDataFrame([(r, r.replace("/", "_")) for r in spec["relations"]], "name string, relation string")
                inst = ingest.read_instances(spark, meta).join(F.broadcast(names), "relation").select(F.col("name").alias("relation"), "source", "target", "label")
                made = datasets.split_from_metadata(inst, e, spec["relations"], spec["percent training"], negative, **tables)
            elif kind == "add negatives to split":
                options = {k: v for k, v in (negative or {}).items() if k != "adj"}
                made = datasets.with_negatives(split(spark, spec["from split"], base), e, g.both_ways(e), spec.get("generate negatives for", "both"), **tables, **options)
            else:
                raise ValueError(f"unknown split type: {kind}")
            sinks.write_split(made, folder)
            sinks.write_params(spark, folder, spec)
    return sinks.read_split(spark, spec, base)


def _named(spec: object, name: str) -> list:
    """Values of a field of that name, wherever it stands; lists give their items."""
    if isinstance(spec, list):
        return [x for y in spec for x in _named(y, name)]
    if not isinstance(spec, dict):
        return []
    own = spec.get(name)
    own = own if isinstance(own, list) else [] if own is None else [own]
    return own + [x for v in spec.values() for x in _named(v, name)]


def run(spark: SparkSession, spec: dict, base: str, name: str) -> experiment.Result | None:
    """One specification: builds what it names, runs its operation over its split, and writes results, parameters and the time that it
    took below results. The operation `no op` only builds."""
    known_keys(spec, ["graph", "split", "relation metadata", "operation", "output"], "the specification")
    began = time.time()
    for x in _named(spec, "embeddings"):
        if isinstance(x, dict):
            embeddings(spark, x, base)
    for x in _named(spec, "similarity matrix"):
        if isinstance(x, dict):
            similarities(spark, x, base)
    edges = graph(spark, spec["graph"], base) if "graph" in spec else None
    for x in _named(spec, "denser matrices"):
        if isinstance(x, dict):
            denser(spark, x, spec["graph"], base)
    rows = split(spark, spec["split"], base) if "split" in spec else None
    log.info("%s: inputs ready after %.1f s", name, time.time() - began)
    if spec.get("operation", {}).get("type") == "no op":
        return None
    unallowed = {}
    if "relation metadata" in spec:
        path = f"{place(spec['relation metadata'], base, 'relation_metadata')}/inverses.tsv"
        inverses = triples.metadata(spark, path, symmetric=True)
        for r in [x[0] for x in rows.select("relation").distinct().collect()]:  # a vocabulary
            unallowed[r] = [x[0] for x in inverses.where(F.col("a") == r).select("b").collect()]
    inputs = {k: v for k, v in spec.items() if k != "relation metadata"}
    result = experiment.train_and_test(spark, inputs, rows, edges, unallowed)
    output = spec.get("output", {})
    known_keys(output, ["output matrices"], "output")
    folder = f"{base.rstrip('/')}/results/{name}"
    experiment.write(result, folder, output.get("output matrices", False))
    log.info("%s: finished after %.1f s", name, time.time() - began)
    sinks.write_params(spark, folder, spec)
    return result


def main(spark: SparkSession, base: str, filters: list[str] = ()) -> list[str]:
    """Runs the specifications below experiment_specs whose names hold a filter, and that have no results; returns their names."""
    folder, done = Path(base.removeprefix("file://")) / "experiment_specs", []
    for path in specs.found(folder, filters, Path(base.removeprefix("file://")) / "results"):
        name = str(path.relative_to(folder).with_suffix(""))
        run(spark, specs.read(path, Path(base.removeprefix("file://")) / "param_files"), base, name)
        done.append(name)
    return done
