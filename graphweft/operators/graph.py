"""Graph building and lookups over edges (s, r, t)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbering import numbered
from ..functions.tables import PARTS, dealt, key_filter, may_hold, part, parts_of, stored

ALIAS = "@ALIAS@"


def both_ways(e: DataFrame) -> DataFrame:
    """Adjacency (n, l, m): every edge from its source under r and from its target under _r."""
    return e.select(F.col("s").alias("n"), F.col("r").alias("l"), F.col("t").alias("m")).unionAll(e.select("t", F.concat(F.lit("_"), "r"), "s"))


def label_name(l: str = "l"):
    return F.regexp_replace(l, "^_", "")


#: Groups of nodes whose edges are counted one after the other in large graphs, so a group's shuffle is gone before the next one's.
PASSES = 2


def capped(adj: DataFrame, cap: int | None) -> DataFrame:
    """Without the relations that leave a node over more than cap edges, both directions together and with multiplicity."""
    if cap is None:
        return adj
    a = adj.withColumn("r", label_name())
    passes = min(PASSES, parts_of(adj))
    hubs = lambda x: stored(x.groupBy("n", "r").count().where(F.col("count") > cap).select("n", "r"), "hubs")
    many = reduce(DataFrame.unionAll, [hubs(a if passes == 1 else a.where(part("n", passes, passes) == i)) for i in range(passes)])  # far fewer than edges, so these need no shuffle
    return a.where("n is not null and r is not null").join(many, ["n", "r"], "left_anti").drop("r")


#: Rows of a search, whose nodes' edges are shuffled at once by an Uncapped adjacency.
ROWS = 2_000_000


@dataclass
class Uncapped:
    """The adjacency of a large graph, which no table holds: each hop reads the edges again, in PARTS groups of nodes at most, and keeps
    those of nodes that it stands on (a filter by hash lets others through, which then join nothing). A relation's edges at a node
    are counted where they lie for the hop."""

    adj: DataFrame
    cap: int | None

    def around(self, now: DataFrame, needed: Column | None = None, meets: DataFrame | None = None) -> Iterator[tuple[DataFrame, DataFrame]]:
        """Groups of the stored rows `now` (node, ...), each with the capped edges (n, l, m) of its nodes. needed: other edges lose their m
        and come once for a node and label; it may read `meets`, true for every m that is among nodes (node) and for some others."""
        groups = max(1, min(PARTS, -(-now.count() // (ROWS if needed is None else 2 * ROWS))))
        of = lambda c: F.pmod(F.xxhash64(c), F.lit(groups))
        e = may_hold(self.adj.where("n is not null and l is not null"), "n", key_filter(now, "node"))
        if needed is not None:
            e = may_hold(e, "m", key_filter(meets, "node"), "meets").select("n", "l", F.when(needed, F.col("m")).alias("m"))
        for i in range(groups):
            x = (e if groups == 1 else e.where(of("n") == i)).repartition("n")
            if self.cap is not None:
                x = x.withColumn("count", F.count("*").over(Window.partitionBy("n", label_name()))).where(F.col("count") <= self.cap).drop("count")
            yield now if groups == 1 else now.where(of("node") == i), x if needed is None else x.distinct()


def searched(adj: DataFrame, cap: int | None) -> list[DataFrame] | Uncapped:
    """What paths.pair_parts() searches: the capped adjacency in a table, which goes, or Uncapped where it is large."""
    return Uncapped(adj, cap) if parts_of(adj) > 1 else dealt(capped(adj, cap), "n", "adjacency")


def neighbours(e: DataFrame) -> DataFrame:
    return both_ways(e).select("n", "m").distinct()


def degrees(e: DataFrame) -> DataFrame:
    """Edges of each node by relation: out, in and both."""
    a = both_ways(e)
    back = F.col("l").startswith("_")
    return a.groupBy("n", label_name().alias("r")).agg(F.count_if(~back).alias("n_out"), F.count_if(back).alias("n_in"), F.count("*").alias("n_both"))


def dictionary(e: DataFrame, order: list[str]) -> DataFrame:
    """Ids from 1 by first appearance, subject before object, of edges sorted by order."""
    pos = numbered(e, order).select("s", "t", "pos")
    first = pos.select(F.col("s").alias("name"), (F.col("pos") * 2).alias("at")).unionAll(pos.select("t", F.col("pos") * 2 + 1)).groupBy("name").agg(F.min("at").alias("at"))
    return numbered(first, ["at"], name="id").select(F.col("id").cast("long"), "name")


def prefixed(e: DataFrame, prefix: str) -> DataFrame:
    return e.withColumn("r", F.concat(F.lit(prefix), "r"))


def relabelled(e: DataFrame, name: str) -> DataFrame:
    return e.withColumn("r", F.lit(name))


def clustered(e: DataFrame, clusters: DataFrame, keep: bool = False) -> DataFrame:
    """Relations as their clusters (r, cluster); unmapped ones stay. keep: the edge under its own relation too."""
    of = clusters.withColumnRenamed("r", "of")
    if keep:
        return e.unionAll(e.join(of, F.col("r") == F.col("of")).select("s", F.col("cluster").alias("r"), "t"))
    return e.join(of, F.col("r") == F.col("of"), "left").select("s", F.coalesce("cluster", "r").alias("r"), "t")


def alias_edges(phrases: DataFrame, aliases: DataFrame, relation: str = ALIAS) -> DataFrame:
    """An edge from each distinct phrase (np) to each of its concepts."""
    return phrases.select("phrase").distinct().join(aliases, "phrase").select(F.col("phrase").alias("s"), F.lit(relation).alias("r"), F.col("concept").alias("t"))


def build(sets: list[dict], deduplicate: bool = False) -> DataFrame:
    """The graph of several relation sets: triples, and optionally prefix, replace, clusters, keep, aliases, alias_relation,
    aliases_only. Alias edges come once for a phrase over all sets and aren't deduplicated with the rest."""
    out, named = None, None
    for x in sets:
        e = x["triples"].select("s", "r", "t")
        if x.get("aliases") is not None:
            ends = e.select(F.col("s").alias("phrase")).union(e.select("t"))
            a = alias_edges(ends, x["aliases"], x.get("alias_relation", ALIAS))
            named = a if named is None else named.union(a).distinct()
        if x.get("aliases_only"):
            continue
        if x.get("replace"):
            e = relabelled(e, x["replace"])
        elif x.get("clusters") is not None:
            e = clustered(e, x["clusters"], x.get("keep", False))
        if x.get("prefix"):
            e = prefixed(e, x["prefix"])
        out = e if out is None else out.unionAll(e)
    if out is not None and deduplicate:
        out = out.dropDuplicates(["s", "r", "t"])
    return named if out is None else out if named is None else out.unionAll(named)


def matrix_sizes(e: DataFrame) -> DataFrame:
    return e.groupBy("r").agg(F.count("*").alias("entries"), F.count_distinct("s", "t").alias("cells"))


def file_groups(sizes: list[tuple[str, int]], most: int) -> list[tuple[str, str]]:
    """Greedy groups of relations in order, each up to most entries, as (first, last)."""
    out, total = [], 0
    for name, n in sizes:
        if out and total + n <= most:
            out[-1], total = (out[-1][0], name), total + n
        else:
            out.append((name, name))
            total = n
    return out


def graph_strings(e: DataFrame, key: str) -> DataFrame:
    """One text a key: its edges in order, in the form that sources.triples.parse_graph reads."""
    line = F.concat_ws("^,^", "s", "r", "t")
    return e.groupBy(key).agg(F.array_join(F.sort_array(F.collect_list(line)), " ### ").alias("graph"))


def unallowed(relation: str, inverses: DataFrame, clusters: DataFrame, edges: DataFrame) -> DataFrame:
    """Relations whose edges are held out for relation: itself, its inverse and the clusters of both, if in the graph."""
    spark = edges.sparkSession
    own = spark.createDataFrame([(relation,)], "r string")
    own = own.unionAll(inverses.where(F.col("a") == relation).select(F.col("b").alias("r")))
    names = own.unionAll(own.join(clusters, "r").select(F.col("cluster").alias("r")))
    return names.join(edges.select("r").distinct(), "r", "left_semi")


def prefixes(files: list[str | None]) -> dict[str, str]:
    """A prefix for each of the distinct cluster files, 1-, 2- and so on in order of first mention; none for a single one."""
    names = list(dict.fromkeys(f for f in files if f))
    return {f: f"{i}-" for i, f in enumerate(names, 1)} if len(names) > 1 else {}


def node(adj: DataFrame, name: str) -> DataFrame:
    """Edges (l, m) of one node: none for one that isn't there."""
    return adj.where(F.col("n") == name).select("l", "m")


def counts(e: DataFrame) -> DataFrame:
    """One row: nodes, relations, edges."""
    nodes = e.select(F.col("s").alias("n")).union(e.select("t")).agg(F.count_distinct("n").alias("nodes"))
    return nodes.crossJoin(e.agg(F.count_distinct("r").alias("relations"), F.count("*").alias("edges")))  # one row each


def has_node(e: DataFrame, name: str) -> bool:
    return not e.where((F.col("s") == name) | (F.col("t") == name)).isEmpty()


def has_edge(e: DataFrame, source: str, relation: str, target: str) -> bool:
    return not e.where((F.col("s") == source) & (F.col("r") == relation) & (F.col("t") == target)).isEmpty()


def grouped(e: DataFrame) -> DataFrame:
    """(n, r, ins, outs): neighbours of each node by relation, in order and with multiplicity, as many as the node has edges."""
    a = both_ways(e)
    back = F.col("l").startswith("_")
    return a.groupBy("n", label_name().alias("r")).agg(F.sort_array(F.collect_list(F.when(back, F.col("m")))).alias("ins"), F.sort_array(F.collect_list(F.when(~back, F.col("m")))).alias("outs"))


def without_tests(e: DataFrame, split: DataFrame) -> DataFrame:
    """Edges but for those of a relation that join one of its test pairs, in either direction."""
    pairs = split.where("fold = 'testing'").select(F.col("relation").alias("r"), F.col("source").alias("s"), F.col("target").alias("t"))
    both = pairs.union(pairs.select("r", F.col("t").alias("s"), F.col("s").alias("t")))
    return e.join(both.distinct(), ["s", "r", "t"], "left_anti").select(*e.columns)


def matrix_files(e: DataFrame, ids: DataFrame, most: int) -> DataFrame:
    """(file, r, s, t): the file that holds a relation's entries: consecutive relation ids (id, name) up to most entries in all, named a
    or a-b. One row a relation comes to the driver, a vocabulary."""
    sizes = e.groupBy("r").agg(F.count("*").alias("n")).join(ids.select(F.col("name").alias("r"), "id"), "r").orderBy("id").collect()
    runs = file_groups([(str(x["id"]), x["n"]) for x in sizes], most)
    names, at = {}, {str(x["id"]): x["r"] for x in sizes}
    order = list(at)
    for a, b in runs:
        for i in order[order.index(a) : order.index(b) + 1]:
            names[at[i]] = a if a == b else f"{a}-{b}"
    of = e.sparkSession.createDataFrame(list(names.items()), "r string, file string")
    return e.join(F.broadcast(of), "r").select("file", "r", "s", "t")
