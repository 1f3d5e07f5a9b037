"""Typed paths: algebra, breadth-first subgraphs of pairs and nodes, filters and matchers."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import forget, part, stored
from .graph import Uncapped


def flip(l: Column) -> Column:
    return F.when(l.startswith("_"), F.substring(l, 2, 1 << 30)).otherwise(F.concat(F.lit("_"), l))


def encode(p: Column) -> Column:
    """-a-_b-; the empty path is -."""
    return F.when(F.size(p) == 0, F.lit("-")).otherwise(F.concat(F.lit("-"), F.array_join(p, "-"), F.lit("-")))


def parse(text: Column) -> Column:
    return F.filter(F.split(text, "-"), lambda x: x != "")


def reversed_path(p: Column) -> Column:
    return F.transform(F.reverse(p), flip)


def joined(p: Column, q: Column) -> Column:
    """From the source along p, and back along q, which begins at the target."""
    return F.concat(p, reversed_path(q))


def lexicalised(p: Column, nodes: Column) -> Column:
    """-a->n1-_b->n2: a node after each hop but, if there is one node less, the last."""
    hop = F.transform(p, lambda x, i: F.concat(F.lit("-"), x, F.lit("->"), F.coalesce(F.get(nodes, i), F.lit(""))))
    return F.array_join(hop, "")


#: Parts the labels of a path while it is a text, which is far smaller than an array.
PART = "\u0001"


def labels(text: Column) -> Column:
    return F.filter(F.split(text, PART), lambda x: x != "")


def _turned(text: Column) -> Column:
    return F.array_join(reversed_path(labels(text)), PART)


def _begun(starts: DataFrame) -> DataFrame:
    return starts.select("*", F.col("start").alias("node"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("array<string>").alias("used"))


def _hop(now: DataFrame, adj: DataFrame, cols: list[str], names: list[str]) -> DataFrame:
    """One hop on from rows (*cols, node, path, used); names: the labels of held-out relations."""
    used, n, m = F.col("used"), F.col("n"), F.col("m")
    if names:
        other = F.when(n == F.col("start"), m).otherwise(n)
        touches = F.col("l").isin(names) & ((n == F.col("start")) | (m == F.col("start")))
        used = F.when(touches, F.array_sort(F.array_union(F.coalesce(used, F.expr("cast(array() as array<string>)")), F.array(other)))).otherwise(used)
    return now.join(adj, F.col("node") == n).select(*cols, m.alias("node"), F.concat_ws(PART, "path", "l").alias("path"), used.alias("used"))


def _hops(now: DataFrame, adj: DataFrame | list[DataFrame], cols: list[str], names: list[str]) -> list[DataFrame]:
    """A hop on over each of the tables of tables.dealt()."""
    if isinstance(adj, DataFrame) or len(adj) == 1:
        return [_hop(now, adj if isinstance(adj, DataFrame) else adj[0], cols, names)]
    return [_hop(now.where(part("node", x.buckets, len(adj)) == i), x, cols, names) for i, x in enumerate(adj)]


def _held(relations: list[str] | None) -> list[str]:
    return [x for r in relations or [] for x in (r, f"_{r}")]


def reached(starts: DataFrame, adj: DataFrame | list[DataFrame], steps: int, held_out: list[str] | None = None) -> DataFrame:
    """(*starts, node, path, used): what 1 to steps hops from each start (start, and columns that follow from it) reach, whatever pair
    it stands in. path: labels with PART between; used: the other ends of edges of a held-out relation on it that touch the start, null
    without any; no pair with one of these takes the path. Distinct after each hop but the last, whose copies are left to the caller.
    adj may be in tables of tables.dealt()."""
    now, out = _begun(starts), None
    for i in range(steps):
        now = reduce(DataFrame.unionAll, _hops(now, adj, starts.columns, _held(held_out)))
        now = now.distinct() if i + 1 < steps else now
        out = now if out is None else out.unionAll(now)
    return out


def _searched(starts: DataFrame, first: DataFrame, adj: Uncapped, steps: int, names: list[str], **options) -> Iterator[DataFrame]:
    """Rows of reached() in tables: those of each hop but the last, stored, and those of the last by group of nodes, not stored and with
    copies. What it has stored goes in the end, so each table is to be read before the next is asked for. first: the edges of the starts;
    options: of Uncapped.around() for the last hop."""
    now, cols, kept = _begun(starts), starts.columns, []
    for i in range(steps):
        last = i + 1 == steps
        made = (_hop(x, e, cols, names) for x, e in ([(now, first)] if i == 0 else adj.around(now, **(options if last else {}))))
        if last:
            yield from made
        else:
            kept += (hop := [stored(x.distinct(), "hop") for x in made])
            now = reduce(DataFrame.unionAll, hop)
            yield now
    for x in kept:
        forget(x)


def _free(other: str, used: str = "used") -> Column:
    return F.col(used).isNull() | ~F.array_contains(used, F.col(other))


def expand(instances: DataFrame, start: str, adj: DataFrame, steps: int, held_out: list[str] | None = None) -> DataFrame:
    """(iid, start, node, path, back): what 1 to steps hops from the start column reach; back is the path turned round. Edges of
    a held-out relation that join source and target, in either direction, are not taken. Distinct."""
    got = reached(instances.select(F.col(start).alias("start")).distinct(), adj, steps, held_out).distinct()
    if held_out:
        own = instances.select("iid", F.col(start).alias("start"), F.col("target" if start == "source" else "source").alias("other")).distinct()
        got = own.join(got, "start").where(_free("other")).select("iid", "start", "node", "path").distinct()
    else:
        got = instances.select("iid", F.col(start).alias("start")).distinct().join(got, "start").select("iid", "start", "node", "path")
    path = labels(F.col("path"))
    return got.select("iid", "start", "node", path.alias("path"), reversed_path(path).alias("back"))


def pair_subgraph(instances: DataFrame, adj: DataFrame, steps: int = 2, held_out: list[str] | None = None) -> DataFrame:
    """(iid, start, node, path): what either end reaches, and the paths from source to target that meet in the middle."""
    a = expand(instances, "source", adj, steps, held_out)
    b = expand(instances, "target", adj, steps, held_out)
    met = a.alias("a").join(b.alias("b"), ["iid", "node"]).select("iid", F.col("a.start").alias("start"), F.col("b.start").alias("node"), F.concat("a.path", "b.back").alias("path"))
    keep = ["iid", "start", "node", "path"]
    return a.select(*keep).unionAll(b.select(*keep)).unionAll(met).distinct()


def _from_targets(instances: DataFrame, adj: DataFrame | list[DataFrame], steps: int, held_out: list[str] | None) -> DataFrame:
    """(target, node, path, back, used) of distinct targets, stored."""
    return _turned_back(reached(instances.select(F.col("target").alias("start")).distinct(), adj, steps, held_out))


def _turned_back(b: DataFrame) -> DataFrame:
    b = b.distinct()
    return stored(b.select(F.col("start").alias("target"), "node", "path", _turned(F.col("path")).alias("back"), "used"), "from-targets")


def _joined(instances: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """(iid, start, node, path as text): the paths from source to target, of what sources reach (start, node, path, used) and of
    _from_targets()."""
    ends = instances.select("target").distinct().select("target", F.col("target").alias("node"), F.lit(None).cast("string").alias("back"), F.lit(None).cast("array<string>").alias("shut"))
    b = b.select("target", "node", "back", F.col("used").alias("shut")).unionAll(ends)
    x = instances.select("iid", F.col("source").alias("start"), "target").distinct().join(a, "start").where(_free("target"))
    x = x.join(b, ["target", "node"]).where(_free("start", "shut"))
    return x.select("iid", "start", F.col("target").alias("node"), F.concat_ws(PART, "path", "back").alias("path")).distinct()


def _meeting(instances: DataFrame, b: DataFrame) -> DataFrame:
    """Nodes where a path from a source may meet one from a target."""
    return stored(b.select("node").union(instances.select("target")).distinct(), "meeting")


def pair_paths(instances: DataFrame, adj: DataFrame, steps: int = 2, held_out: list[str] | None = None) -> DataFrame:
    """The rows of pair_subgraph that join source and target, without the others: what a walk from the source reaches is joined once,
    with what the target reaches and the target itself."""
    b = _from_targets(instances, adj, steps, held_out)
    a = reached(instances.select(F.col("source").alias("start")).distinct(), adj, steps, held_out)
    met = _joined(instances, a.join(_meeting(instances, b), "node", "left_semi").distinct(), b)
    return met.select("iid", "start", "node", labels(F.col("path")).alias("path"))


def pair_parts(instances: DataFrame, adj: DataFrame | list[DataFrame] | Uncapped, steps: int = 2, held_out: list[str] | None = None, nodes: bool = True) -> tuple[DataFrame, DataFrame]:
    """The rows of pair_subgraph, paths as text, in two tables: (start, times, node, path), which all `times` instances with that
    source share, and (iid, source, start, node, path) of single instances, both with copies. nodes: False leaves the node
    null in the shared ones. iid is a key. adj: a table, those of tables.dealt(), which go, or an Uncapped one. Work and storage for what sources reach follow the sources and not the instances."""
    shared, single, met = pair_parts_met(instances, adj, steps, held_out, nodes)
    return shared, single.unionAll(met)


def pair_parts_met(instances: DataFrame, adj: DataFrame | list[DataFrame] | Uncapped, steps: int = 2, held_out: list[str] | None = None, nodes: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """pair_parts() with the rows that pair_paths() gives apart from the other ones of single instances."""
    starts = instances.groupBy(F.col("source").alias("start")).agg(F.count_distinct("iid").alias("times"))
    if isinstance(adj, Uncapped):
        starts, targets = stored(starts, "starts"), stored(instances.select(F.col("target").alias("start")).distinct(), "starts")
        ends = stored(starts.select(F.col("start").alias("node")).union(targets).distinct(), "ends")
        edges = [stored(e, "first") for _, e in adj.around(ends)]
        first = reduce(DataFrame.unionAll, edges)
        b = _turned_back(reduce(DataFrame.unionAll, [stored(x.distinct(), "reached") for x in _searched(targets, first, adj, steps, _held(held_out))]))
    else:
        b = _from_targets(instances, adj, steps, held_out)
    meeting = _meeting(instances, b).select("node", F.lit(True).alias("meets"))

    def kept(x: DataFrame) -> DataFrame:
        x = x.join(meeting, "node", "left")
        x = x.select("start", "times", F.col("node") if nodes else F.when(F.col("meets"), F.col("node")).alias("node"), "path", "used", "meets")
        return stored(x if nodes else x.distinct(), "from-sources")  # with nodes few rows are copies

    if isinstance(adj, DataFrame):
        a = kept(reached(starts, adj, steps, held_out))
    elif isinstance(adj, Uncapped):
        some = {} if nodes else {"needed": F.col("l").isin(_held(held_out)) | F.col("meets"), "meets": meeting.select("node")}
        a = reduce(DataFrame.unionAll, [kept(x) for x in _searched(starts, first, adj, steps, _held(held_out), **some)])
        for x in edges:
            forget(x)
    else:  # the last hop goes over one table after the other, and each goes then
        now, names, got = _begun(starts), _held(held_out), []
        for _ in range(steps - 1):
            now = stored(reduce(DataFrame.unionAll, _hops(now, adj, starts.columns, names)).distinct(), "hop")
            got.append(kept(now))
        for x, table in zip(_hops(now, adj, starts.columns, names), adj):
            got.append(kept(x))
            forget(table)
        a = reduce(DataFrame.unionAll, got)
    cols = ["iid", "source", "start", "node", "path"]
    pairs = instances.select("iid", "source", "target").distinct()
    some = pairs.join(a.where("used is not null").drop("times"), F.col("source") == F.col("start")).where(_free("target")).select(*cols)
    other = pairs.join(b, "target").where(_free("source")).select("iid", "source", F.col("target").alias("start"), "node", "path")
    met = _joined(instances, a.where("meets").select("start", "node", "path", "used"), b).select("iid", F.col("start").alias("source"), "start", "node", "path")
    return a.where("used is null").select("start", "times", "node", "path"), some.unionAll(other), met


#: Parts of the keys that are counted one after the other where keys are about as many as rows, so a part's shuffle is gone
#: before the next one's.
PASSES = 6


def shared_counts(shared: DataFrame, single: DataFrame, key: list[str], many: bool = False) -> DataFrame:
    """(*key, n): how many instances have each key, of shared rows (*key, start, times) and rows (*key, start, iid) of single ones, whose
    start is the source that may have the key for all its instances, or null. many: keys are about as many as rows, so rows are dealt
    by key alone, once, and stored in PASSES parts."""

    def counted(shared: DataFrame, single: DataFrame) -> DataFrame:
        one = single.select(*key, "start", "iid").distinct()
        every = shared.select(*key, "start", "times", F.lit(0).alias("k")).unionAll(one.select(*key, "start", F.lit(None).cast("long"), F.lit(1)))
        every = every.repartition(*key) if many else every
        own = every.groupBy(*key, "start").agg(F.max("times").alias("times"), F.sum("k").alias("k"))
        return own.groupBy(*key).agg(F.sum(F.coalesce("times", "k")).alias("n"))

    if not many:
        return counted(shared, single)
    of = F.pmod(F.xxhash64(*key), F.lit(PASSES))
    return reduce(DataFrame.unionAll, [stored(counted(shared.where(of == i), single.where(of == i)), "counts") for i in range(PASSES)])


def node_subgraph(instances: DataFrame, adj: DataFrame, steps: int = 2) -> DataFrame:
    return expand(instances, "source", adj, steps).select("iid", "start", "node", "path").distinct()


def path_counts(subgraph: DataFrame, instances: DataFrame) -> DataFrame:
    """How many pairs each path joins."""
    ends = instances.select("iid", "source", "target")
    return subgraph.join(ends, "iid").where("start = source and node = target").groupBy(encode(F.col("path")).alias("path")).agg(F.count_distinct("iid").alias("n_pairs"))


def pattern(text: str) -> str:
    """A regular expression over labels that are each followed by \\u0001, from a pattern such as a,*,_b: * any run, + a run of
    one or more; either must leave something for what follows."""
    parts, one = text.split(","), "[^\u0001]+\u0001"
    out = "^"
    for i, p in enumerate(parts):
        last = i == len(parts) - 1
        if p in "*+":
            out += f"(?:{one}){p}" + ("" if last else "(?=.)")
        else:
            out += re.escape(p) + "\u0001"
    return out + ("" if parts[-1] == "*" else "$")


def allowed(path: Column, include: list[str] = (), exclude: list[str] = ()) -> Column:
    line = F.array_join(F.transform(path, lambda x: F.concat(x, F.lit("\u0001"))), "")
    keep = F.lit(True)
    if include:
        keep = F.lit(False)
        for p in include:
            keep = keep | line.rlike(pattern(p))
    for p in exclude:
        keep = keep & ~line.rlike(pattern(p))
    return keep


def related(starts: DataFrame, adj: DataFrame, hops: list[dict]) -> DataFrame:
    """(start, node): nodes that a guided search reaches. A hop has labels, and may fix the node that it ends at; distinct after
    each hop, so work follows nodes and not walks. The start itself is left out."""
    now = starts.select(F.col("n").alias("start"), F.col("n").alias("node")).distinct()
    for hop in hops:
        e = adj.where(F.col("l").isin(hop["labels"]))
        if hop.get("node"):
            e = e.where(F.col("m") == hop["node"])
        now = now.join(e, F.col("node") == F.col("n")).select("start", F.col("m").alias("node")).distinct()
    return now.where("start <> node")


def related_any(starts: DataFrame, adj: DataFrame, features: list[str], from_target: bool = False) -> DataFrame:
    """(start, node): what any of the features reaches; malformed ones reach nothing."""
    out = starts.select(F.col("n").alias("start"), F.col("n").alias("node")).limit(0)
    for f in features:
        hops = matcher(f, from_target)
        if hops:
            out = out.unionAll(related(starts, adj, hops))
    return out.distinct()


def matcher(feature: str, from_target: bool = False) -> list[dict] | None:
    """Hops of a path feature (-a-_b- or -a->n1-_b->), from its target's side if asked; None if it is malformed."""
    if not re.fullmatch(r"-(?:[^-]+-)+|(?:-[^->]+->[^-]*)+", feature):
        return None
    if "->" in feature:
        hops = [{"labels": [a], "node": b or None} for a, b in re.findall(r"-([^->]+)->([^-]*)", feature)]
    else:
        hops = [{"labels": [a]} for a in feature.strip("-").split("-")]
    if from_target:
        turned = lambda x: x[1:] if x.startswith("_") else f"_{x}"
        nodes = [h.get("node") for h in hops][:-1][::-1] + [None]
        hops = [{"labels": [turned(h["labels"][0])], "node": n} for h, n in zip(hops[::-1], nodes)]
    return hops
