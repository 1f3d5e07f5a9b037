"""Splits of instances, sampled negatives and potential predictions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbering import numbered
from ..functions.tables import stored
from . import walks

#: Weight over the total of the drawn ones that falls to the original end; draws for each negative that is wanted.
KEEP, ATTEMPTS = 1.25, 10
#: Draws that are shuffled at once, and the most parts of the pairs that are drawn for one after the other.
DRAWS, PASSES = 5_000_000, 6


def prefix_split(inst: DataFrame, percent: float, order: list[str], by: list[str] = ("label",)) -> DataFrame:
    """fold: training for the first floor(percent * n) of each group in order, else testing."""
    sizes = inst.groupBy(*by).agg(F.count("*").alias("n__"))
    out = numbered(inst, order, list(by), "pos__").join(sizes, list(by))
    return out.select(*inst.columns, F.when(F.col("pos__") <= F.floor(F.lit(percent) * F.col("n__")), "training").otherwise("testing").alias("fold"))


def members(edges: DataFrame) -> DataFrame:
    """Nodes (n) of the graph."""
    return edges.select(F.col("s").alias("n")).union(edges.select("t")).distinct()


def allowed_nodes(edges: DataFrame, categories: DataFrame, category: str) -> DataFrame:
    """Members of a category (a, b) that are in the graph. A category that has none raises."""
    own = categories.where(F.col("a") == category).select(F.col("b").alias("n"))
    if own.isEmpty():
        raise ValueError(f"no members of category {category}")
    return members(edges).join(own, "n", "left_semi")


def in_graph(inst: DataFrame, edges: DataFrame) -> DataFrame:
    """Instances whose source and target are nodes of the graph."""
    nodes = members(edges)
    return inst.join(nodes.withColumnRenamed("n", "source"), "source", "left_semi").join(nodes.withColumnRenamed("n", "target"), "target", "left_semi").select(*inst.columns)


def chance(*at: Column | str) -> Column:
    """A number from 0 to 1 (52 bits) that the values at this place draw: neither partitioning nor a repeated task changes it."""
    digest = F.md5(F.concat_ws("|", *[F.col(x).cast("string") if isinstance(x, str) else x.cast("string") for x in at]).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def _drawable(shares: DataFrame, most: int) -> DataFrame:
    """For each start its most visited nodes (ties by name) up to their running totals, and the total: what a draw looks in."""
    best = walks.top(shares, "start", "share", "node", most)
    w = Window.partitionBy("start").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    best = best.withColumn("hi", F.sum("share").over(w))
    return best.groupBy("start").agg(F.sort_array(F.collect_list(F.struct("hi", "node"))).alias("upto"), F.sum("share").alias("total"))  # most nodes at most


def negatives(positives: DataFrame, source_shares: DataFrame, target_shares: DataFrame, others: DataFrame | None = None, ratio: int = 3, seed: int = 1, most: int = 100) -> DataFrame:
    """Up to ratio pairs (source, target, label -1) for each positive: a new source and a new target, each drawn by the page rank from
    the old one (start, node, share), which itself keeps a quarter of the total. Known positives, those in others too, are never
    drawn; ATTEMPTS draws for each that is wanted, of which the first distinct ones stay; what two positives draw comes once."""
    tables = [(_drawable(x, most).withColumnRenamed("start", "key"), None) for x in (source_shares, target_shares)]
    return _drawn(positives, tables, others, ratio, seed)


def _drawn(positives: DataFrame, tables: list[tuple[DataFrame, DataFrame | None]], others: DataFrame | None, ratio: int, seed: int) -> DataFrame:
    """negatives() from what each end draws from: (key, upto, total), and (n, key) of nodes, or None where they are the keys. Lists are
    looked in where they are joined, so no shuffle carries them. Many pairs are drawn for in parts, whose shuffles are gone one by one."""
    pairs = stored(positives.select("source", "target").distinct(), "positives")
    known = pairs if others is None else stored(pairs.union(others.select("source", "target")).distinct(), "known")
    parts = max(1, min(PASSES, -(-pairs.count() * ATTEMPTS * ratio // DRAWS)))
    if parts == 1:
        return _drawn_for(pairs, known, tables, ratio, seed).distinct()
    of = F.pmod(F.xxhash64("source", "target"), F.lit(parts))
    return reduce(DataFrame.unionAll, [stored(_drawn_for(pairs.where(of == i), known, tables, ratio, seed), "drawn") for i in range(parts)]).distinct()


def _drawn_for(pairs: DataFrame, known: DataFrame, tables: list[tuple[DataFrame, DataFrame | None]], ratio: int, seed: int) -> DataFrame:
    """What is drawn for the pairs, with copies."""
    x, tries = pairs, F.sequence(F.lit(0), F.lit(ATTEMPTS * ratio - 1))
    for end, (lists, keys) in zip(("source", "target"), tables):
        if keys is None:
            x = x.withColumn("key", F.col(end))
        else:
            x = x.join(keys.select(F.col("n").alias(end), "key"), end, "left")
        # drawn once each, not once for each node that they are compared with
        values = F.transform(tries, lambda i: F.floor(chance("source", "target", i, F.lit(end), F.lit(seed)) * F.lit(KEEP) * F.col("total")).cast("long"))
        new = F.transform(values, lambda v: F.get("upto", F.size(F.filter("upto", lambda c: c["hi"] <= v)))["node"])
        x = x.join(lists, "key", "left").withColumn(f"new_{end}", F.transform(new, lambda n: F.coalesce(n, F.col(end)))).drop("key", "upto", "total")
    both = F.array_distinct(F.arrays_zip(F.col("new_source"), F.col("new_target")))  # the first of equal ones stays
    x = x.select("source", "target", F.posexplode(both).alias("attempt", "z"))
    drawn = x.select("source", "target", "z.new_source", "z.new_target", "attempt")
    drawn = drawn.join(known.select(F.col("source").alias("new_source"), F.col("target").alias("new_target")), ["new_source", "new_target"], "left_anti")
    w = Window.partitionBy("source", "target").orderBy("attempt")  # ATTEMPTS * ratio rows at most
    drawn = drawn.withColumn("k", F.row_number().over(w)).where(F.col("k") <= ratio)
    return drawn.select(F.col("new_source").alias("source"), F.col("new_target").alias("target"), F.lit(-1).alias("label"))


def _ranks(starts: DataFrame, adj: DataFrame, steps: int, restart: float, allowed: DataFrame | None, most: int) -> tuple[DataFrame, DataFrame]:
    """What _drawn() draws from for starts (n). Walks begin at the first of all starts with the same edges. From another of these it is
    the same but for two nodes that change places: itself, which is not drawn, and the first, which it reaches as the first does any
    of them. So a set of them has one list, and one for the first and for each that is in the first's."""
    kinds = stored(walks.twins(starts, adj), "twins")
    shares = stored(walks.rank_shares(kinds.select(F.col("first").alias("n")).distinct(), adj, steps, restart), "ranks")
    fits = shares if allowed is None else shares.join(allowed.select(F.col("n").alias("node")).distinct(), "node", "left_semi")
    best = stored(walks.top(fits.select("start", "node", "share"), "start", "share", "node", most + 1).select("start", "node", "share"), "best")
    like = shares.join(kinds.select(F.col("n").alias("node"), F.col("first").alias("of")), "node").where("start = of")
    like = like.groupBy("start").agg(F.max("share").alias("share"))
    like = like if allowed is None else like.join(allowed.select(F.col("n").alias("start")).distinct(), "start", "left_semi")
    others = kinds.where("n <> first")
    own = best.join(others.select(F.col("n").alias("node"), F.col("first").alias("start")), ["start", "node"], "left_semi").select("start", F.col("node").alias("n"))
    rest = others.select(F.col("first").alias("start")).distinct().withColumn("n", F.lit(None).cast("string"))
    sets = stored(own.unionAll(rest), "sets")
    key = F.coalesce(F.concat(F.lit("="), "n"), F.concat(F.lit("*"), "start")).alias("key")
    moved = best.join(sets, "start").where("n is null or node <> n").select(key, "node", "share").unionAll(like.join(sets, "start").select(key, F.col("start").alias("node"), "share"))
    lists = best.select(F.concat(F.lit("="), "start").alias("key"), "node", "share").unionAll(moved)
    lists = stored(_drawable(lists.withColumnRenamed("key", "start"), most).withColumnRenamed("start", "key"), "lists")
    single = kinds.join(own.select("n", F.lit(True).alias("own")), "n", "left")
    return lists, single.select("n", F.when((F.col("n") == F.col("first")) | F.col("own"), F.concat(F.lit("="), "n")).otherwise(F.concat(F.lit("*"), "first")).alias("key"))


def ranked_negatives(positives: DataFrame, adj: DataFrame, others: DataFrame | None = None, sources: DataFrame | None = None, targets: DataFrame | None = None, ratio: int = 3, steps: int = 4, restart: float = 0.15, seed: int = 1) -> DataFrame:
    """negatives() by walks from both ends; sources and targets (n): only these may stand on that side."""
    tables = [_ranks(positives.select(F.col(end).alias("n")), adj, steps, restart, fits, 100) for end, fits in (("source", sources), ("target", targets))]
    return _drawn(positives, tables, others, ratio, seed)


def potential_predictions(domain: DataFrame, adj: DataFrame, known: DataFrame, allowed: DataFrame | None = None, ratio: int = 3, most: int = 1000, steps: int = 4, restart: float = 0.15, seed: int = 1) -> DataFrame:
    """(source, target): for up to most nodes n of the domain, those with the smallest draws, the ratio targets that walks from it visit
    most (ties by name), known pairs left out; up to most of them, again by draw. allowed: only these nodes are targets."""
    few = lambda df, *at: df.orderBy(chance(*at, F.lit(seed)), *at).limit(most)
    starts = few(domain.select("n").distinct(), "n")
    shares = walks.rank_shares(starts, adj, steps, restart, allowed).select(F.col("start").alias("source"), F.col("node").alias("target"), "share")
    shares = shares.join(known.select("source", "target").distinct(), ["source", "target"], "left_anti")
    return few(walks.top(shares, "source", "share", "target", ratio).select("source", "target"), "source", "target")


def _limits(edges: DataFrame, relation: str, of: DataFrame | None, categories: DataFrame | None) -> DataFrame | None:
    """Nodes that may stand at one end of a relation: members of the category that is its domain or range (a, b) in the graph. None, for
    all, without such a table or without members; a relation that the table lacks raises."""
    if of is None:
        return None
    named = of.where(F.col("a") == relation).select("b").head(1)
    if not named:
        raise ValueError(f"no domain or range of relation {relation}")
    own = None if categories is None else categories.where(F.col("a") == named[0][0])
    return None if own is None or own.isEmpty() else allowed_nodes(edges, categories, named[0][0])


def split_from_metadata(instances: DataFrame, edges: DataFrame, relations: list[str], percent: float, negative: dict | None = None, domains: DataFrame | None = None, ranges: DataFrame | None = None, categories: DataFrame | None = None) -> DataFrame:
    """A split (relation, fold, source, target, label) of a metadata folder's instances (relation, source, target, label). negative:
    options of ranked_negatives (adj and, if wanted, ratio, steps, restart, seed), whose pairs join the instances before the first
    percent of each label, in order of source and target, go to training."""
    if not relations:
        raise ValueError("a split needs relations")
    out = instances.where(F.col("relation").isin(relations)).select("relation", "source", "target", "label")
    if negative is not None:
        for r in relations:  # a vocabulary
            own = in_graph(instances.where((F.col("relation") == r) & (F.col("label") > 0)), edges)
            drawn = ranked_negatives(own, sources=_limits(edges, r, domains, categories), targets=_limits(edges, r, ranges, categories), **negative)
            out = out.unionByName(stored(drawn.select(F.lit(r).alias("relation"), "source", "target", "label"), "negatives"))
    return prefix_split(out, percent, ["source", "target"], ["relation", "label"]).select("relation", "fold", "source", "target", "label")


def with_negatives(split: DataFrame, edges: DataFrame, adj: DataFrame, to: str = "both", domains: DataFrame | None = None, ranges: DataFrame | None = None, categories: DataFrame | None = None, **options) -> DataFrame:
    """A split with sampled negatives for training, test or both. Training positives are not drawn for the tests; instances with an
    end outside the graph stay but nothing is drawn from them."""
    if to not in ("training", "test", "both"):
        raise ValueError(f"negatives for what: {to}")
    out = split.select("relation", "fold", "source", "target", "label")
    positive = stored(in_graph(split.where("label > 0"), edges), "positive")  # else every table of the walks looks through the graph again
    for r in [x[0] for x in split.select("relation").distinct().orderBy("relation").collect()]:  # a vocabulary
        limits = {"sources": _limits(edges, r, domains, categories), "targets": _limits(edges, r, ranges, categories)}
        limits = {k: x if x is None else stored(x, k) for k, x in limits.items()}
        own = positive.where(F.col("relation") == r)
        for fold, name in (("training", "training"), ("testing", "test")):
            if to in (name, "both"):
                others = own.where("fold = 'training'") if fold == "testing" else None
                drawn = ranked_negatives(own.where(F.col("fold") == fold), adj, others, **limits, **options)
                out = out.unionByName(stored(drawn.select(F.lit(r).alias("relation"), F.lit(fold).alias("fold"), "source", "target", "label"), "negatives"))
    return out
