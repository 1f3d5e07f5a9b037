"""Paths with the nodes that they go through: path is an array of labels, nodes the node after each hop, without the last one where a
path was joined from both of its ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .paths import flip, reversed_path


def shown(node: Column, colon: str = "no") -> Column:
    """A node's name in a path. colon: no, as it is; yes, what follows its last colon; filter, by the tag after the first colon:
    KEEP shows what follows the last one, REMOVE nothing, any other raises."""
    parts = F.split(node, ":")
    if colon == "no":
        return node
    if colon == "yes":
        return F.element_at(parts, -1)
    if colon != "filter":
        raise ValueError(f"unknown way with colons: {colon}")
    tag = F.get(parts, F.lit(1))
    wrong = F.raise_error(F.concat(F.lit("a node's tag is neither KEEP nor REMOVE: "), node))
    return F.when(~node.contains(":"), node).when(tag == "KEEP", F.element_at(parts, -1)).when(tag == "REMOVE", F.lit("")).otherwise(wrong)


def encode(path: Column, nodes: Column, colon: str = "no") -> Column:
    """-a->n1-_b->n2; a path without its last node ends in ->."""
    hop = F.transform(path, lambda x, i: F.concat(F.lit("-"), x, F.lit("->"), F.when(i < F.size(nodes), shown(F.get(nodes, i), colon)).otherwise(F.lit(""))))
    return F.array_join(hop, "")


def labels_only(path: Column) -> Column:
    return F.concat(F.array_join(F.transform(path, lambda x: F.concat(F.lit("-"), x)), ""), F.lit("-"))


def parse(text: Column) -> tuple[Column, Column]:
    """(path, nodes) of -a->n1-_b->n2. A node's name may hold no hyphen; text that ends in -> has no last node."""
    path = F.regexp_extract_all(text, F.lit("-([^->]+)->"), F.lit(1))
    return path, F.filter(F.regexp_extract_all(text, F.lit("->([^-]*)"), F.lit(1)), lambda x: x != "")


def appended(path: Column, nodes: Column, label: Column, node: Column) -> tuple[Column, Column]:
    return F.concat(path, F.array(label)), F.concat(nodes, F.array(node))


def reversed_nodes(path: Column, nodes: Column) -> tuple[Column, Column]:
    return reversed_path(path), F.reverse(nodes)


def joined(path: Column, nodes: Column, back: Column, back_nodes: Column) -> tuple[Column, Column]:
    """From the source along path and on along the turned path from the target. Both end at one node, which is kept once; an empty path
    from the target leaves the other without its last node. Ends that differ raise, and so do paths that lack their last node."""
    short = (F.size(path) != F.size(nodes)) | (F.size(back) != F.size(back_nodes))
    apart = (F.size(path) > 0) & (F.element_at(nodes, -1) != F.element_at(back_nodes, -1))
    rest = F.reverse(F.slice(back_nodes, 1, F.greatest(F.size(back_nodes) - 1, F.lit(0))))
    cut = F.slice(nodes, 1, F.greatest(F.size(nodes) - 1, F.lit(0)))
    out = F.when(F.size(back) == 0, cut).when(apart, F.raise_error(F.lit("paths that end at different nodes can't be joined")))
    out = out.when(short, F.raise_error(F.lit("a path that was joined can't be joined again"))).when(F.size(path) == 0, rest).otherwise(F.concat(nodes, rest))
    return F.concat(path, reversed_path(back)), out


def expand(instances: DataFrame, start: str, adj: DataFrame, steps: int, held_out: list[str] = ()) -> DataFrame:
    """(iid, start, node, path, nodes): what 1 to steps hops from the start column reach, with the nodes on the way; distinct."""
    names = [x for r in held_out for x in (r, f"_{r}")]
    empty = F.expr("cast(array() as array<string>)")
    now = instances.select("iid", "source", "target", F.col(start).alias("start"), F.col(start).alias("node"), empty.alias("path"), empty.alias("nodes"))
    out = None
    for _ in range(steps):
        step = now.join(adj, F.col("node") == F.col("n"))
        if names:
            ends = ((F.col("n") == F.col("source")) & (F.col("m") == F.col("target"))) | ((F.col("n") == F.col("target")) & (F.col("m") == F.col("source")))
            step = step.where(~(F.col("l").isin(names) & ends))
        path, nodes = appended(F.col("path"), F.col("nodes"), F.col("l"), F.col("m"))
        now = step.select("iid", "source", "target", "start", F.col("m").alias("node"), path.alias("path"), nodes.alias("nodes")).distinct()
        out = now if out is None else out.unionAll(now)
    return out.select("iid", "start", "node", "path", "nodes")


def between(instances: DataFrame, adj: DataFrame, steps: int = 2, held_out: list[str] = ()) -> DataFrame:
    """(iid, path, nodes): paths from source to target, from one end or joined in the middle."""
    a, b = expand(instances, "source", adj, steps, held_out), expand(instances, "target", adj, steps, held_out)
    own = a.join(instances.select("iid", F.col("target").alias("node")), ["iid", "node"], "left_semi").select("iid", "path", "nodes")
    turned = b.join(instances.select("iid", F.col("source").alias("node")), ["iid", "node"], "left_semi")
    cut = F.slice("nodes", 1, F.size("nodes") - 1)
    other = turned.select("iid", F.transform(F.reverse("path"), flip).alias("path"), F.reverse(cut).alias("nodes"))
    path, nodes = joined(F.col("a.path"), F.col("a.nodes"), F.col("b.path"), F.col("b.nodes"))
    met = a.alias("a").join(b.alias("b"), ["iid", "node"]).select("iid", path.alias("path"), nodes.alias("nodes"))
    return own.select("iid", "path", cut.alias("nodes")).unionAll(other).unionAll(met).distinct()


def pra_with_nodes(instances: DataFrame, adj: DataFrame, steps: int = 2, held_out: list[str] = (), colon: str = "no") -> DataFrame:
    """(iid, feature): paths that join source and target, with the nodes in between."""
    return between(instances, adj, steps, held_out).select("iid", encode(F.col("path"), F.col("nodes"), colon).alias("feature")).distinct()
