"""Features of instances from their subgraphs (iid, start, node, path), hashing and feature matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbering import numbered
from ..functions.tables import stored
from .paths import allowed, encode, labels, shared_counts

ANY = "@ANY_REL@"


def _between(sub: DataFrame, inst: DataFrame) -> DataFrame:
    return sub.join(inst.select("iid", "source", "target"), "iid").where("start = source and node = target").select("iid", "path").distinct()


def _made(df: DataFrame, feature: Column) -> DataFrame:
    return df.select("iid", feature.alias("feature")).distinct()


def pra(sub: DataFrame, inst: DataFrame, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """Paths that join source and target."""
    return _made(_between(sub, inst).where(allowed(F.col("path"), include, exclude)), encode(F.col("path")))


def one_sided(sub: DataFrame, inst: DataFrame, end: bool = True) -> DataFrame:
    """Paths from either end, with the node where they end if asked."""
    x = sub.join(inst.select("iid", "source", "target"), "iid").where("start = source or start = target")
    name = F.concat(F.when(F.col("start") == F.col("source"), "SOURCE:").otherwise("TARGET:"), encode(F.col("path")))
    return _made(x, F.concat(name, F.lit(":"), "node") if end else name)


def _one_sided_name(path: Column, node: Column | None = None) -> Column:
    name = F.concat(F.when(F.col("start") == F.col("source"), "SOURCE:").otherwise("TARGET:"), encode(labels(path)))
    return name if node is None else F.concat(name, F.lit(":"), node)


def one_sided_paths(parts: tuple[DataFrame, DataFrame], inst: DataFrame) -> DataFrame:
    """one_sided() without end nodes, of paths.pair_parts()."""
    shared, single = parts
    every = shared.select("start", "path").distinct().join(inst.select("iid", F.col("source").alias("start")).distinct(), "start").select("iid", F.col("start").alias("source"), "start", "path")
    return _made(every.unionAll(single.select("iid", "source", "start", "path")), _one_sided_name(F.col("path")))


def one_sided_counts(parts: tuple[DataFrame, DataFrame], end: bool = True, size: int | None = None) -> DataFrame:
    """(feature, n): how many instances have each feature of one_sided(), or each of hashed() of these to a size, of
    paths.pair_parts(), without a row for each instance and node."""
    shared, single = parts
    shared = shared.withColumn("source", F.col("start"))
    if size is not None:
        last = [F.col("node")] if end else []
        text = lambda path: F.concat(F.lit("SOURCE:"), encode(labels(path)), F.lit(":") if end else F.lit(""))
        begun = stored(shared.select("path").distinct().withColumn("begun", _code(text(F.col("path")))), "begun")  # paths are hashed once
        code = _bucket(_code(F.col("node"), F.col("begun")) if end else F.col("begun"), size).alias("code")
        x = shared.join(begun, "path").select("start", "times", code).distinct()
        one = single.select("iid", F.col("source").alias("start"), _bucket(_code(_one_sided_name(F.col("path"), *last)), size).alias("code"))
        return shared_counts(x, one, ["code"]).select(F.concat(F.lit("hash-"), F.col("code").cast("string")).alias("feature"), "n")
    key = ["side", "path", "node"] if end else ["side", "path"]
    side = (F.col("start") == F.col("source")).alias("side")
    x = shared_counts(shared.select("start", "times", side, *key[1:]), single.select("iid", F.col("source").alias("start"), side, *key[1:]), key, many=end)
    x = x.withColumns({"start": F.when(F.col("side"), F.lit("a")).otherwise("b"), "source": F.lit("a")})
    return x.select(_one_sided_name(F.col("path"), F.col("node") if end else None).alias("feature"), "n").groupBy("feature").agg(F.sum("n").alias("n"))


def _sides(sub: DataFrame, inst: DataFrame) -> DataFrame:
    x = sub.join(inst.select("iid", "source", "target"), "iid")
    a = x.where("start = source").select("iid", "path", F.col("node").alias("a"))
    b = x.where("start = target").select("iid", "path", F.col("node").alias("b"))
    return a.join(b, ["iid", "path"])


def categorical(sub: DataFrame, inst: DataFrame) -> DataFrame:
    return _made(_sides(sub, inst), F.concat(F.lit("CATCOMP:"), encode(F.col("path")), F.lit(":"), "a", F.lit(":"), "b"))


def numerical(sub: DataFrame, inst: DataFrame) -> DataFrame:
    """log10 of the difference of the numbers that both ends reach over one path, to two places."""
    x = _sides(sub, inst).select("iid", "path", F.col("a").try_cast("double").alias("a"), F.col("b").try_cast("double").alias("b")).where("a is not null and b is not null")
    far = F.when(F.col("a") == F.col("b"), F.lit("-Infinity")).otherwise(F.round(F.log10(F.abs(F.col("a") - F.col("b"))), 2).cast("string"))
    return _made(x, F.concat(F.lit("NUMCOMP:"), encode(F.col("path")), F.lit(":"), far))


def bigrams(sub: DataFrame, inst: DataFrame) -> DataFrame:
    full = F.concat(F.array(F.lit("@START@")), "path", F.array(F.lit("@END@")))
    x = _between(sub, inst).select("iid", full.alias("p")).select("iid", F.explode(F.arrays_zip(F.slice("p", 1, F.size("p") - 1).alias("x"), F.slice("p", 2, F.size("p")).alias("y"))).alias("z"))
    return _made(x, F.concat(F.lit("BIGRAM:"), "z.x", F.lit("-"), "z.y"))


def _one_replaced(x: DataFrame, by: Column, where: Column) -> DataFrame:
    at = x.select("iid", "path", F.posexplode("path").alias("i", "label")).where(where)
    return at.select("iid", F.concat(F.slice("path", 1, F.col("i")), F.array(by), F.slice("path", F.col("i") + 2, F.size("path"))).alias("path"))


def any_relation(sub: DataFrame, inst: DataFrame, alias: str | None = None) -> DataFrame:
    """One position of a path that joins the ends stands for any relation. alias: only inner ones of paths between alias edges."""
    x, where = _between(sub, inst), F.lit(True)
    if alias is not None:
        bare = lambda c: F.regexp_replace(c, "^_", "")
        x = x.where((F.size("path") > 2) & (bare(F.element_at("path", 1)) == alias) & (bare(F.element_at("path", -1)) == alias))
        where = (F.col("i") > 0) & (F.col("i") < F.size("path") - 1)
    return _made(_one_replaced(x, F.lit(ANY), where), F.concat(F.lit("ANYREL:"), encode(F.col("path"))))


def similar_relations(sims: DataFrame, most: int = 10) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("r1").orderBy(F.desc("weight"), "r2")
    return sims.where("r1 <> r2").withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).select("r1", "r2")


def vector_similar(sub: DataFrame, inst: DataFrame, sims: DataFrame, most: int = 10) -> DataFrame:
    """Paths that join the ends, with no position or one replaced: by any relation or by a similar one."""
    x = _between(sub, inst)
    near = similar_relations(sims, most)
    at = x.select("iid", "path", F.posexplode("path").alias("i", "label")).withColumn("r1", F.regexp_replace("label", "^_", ""))
    like = at.join(near, "r1").withColumn("by", F.when(F.col("label").startswith("_"), F.concat(F.lit("_"), "r2")).otherwise(F.col("r2")))
    like = like.select("iid", F.concat(F.slice("path", 1, F.col("i")), F.array("by"), F.slice("path", F.col("i") + 2, F.size("path"))).alias("path"))
    every = x.unionAll(_one_replaced(x, F.lit(ANY), F.lit(True))).unionAll(like)
    return _made(every, F.concat(F.lit("VECSIM:"), encode(F.col("path"))))


def connected(sub: DataFrame, inst: DataFrame, name: str = "CONNECTED") -> DataFrame:
    return _made(_between(sub, inst).where(F.size("path") == 1), F.lit(name))


def mediated(sub: DataFrame, inst: DataFrame, mediators: list[str], name: str = "CONNECTED_BY_MEDIATOR") -> DataFrame:
    bare = F.transform("path", lambda c: F.regexp_replace(c, "^_", ""))
    return _made(_between(sub, inst).where((F.size("path") == 2) & F.forall(bare, lambda c: c.isin(mediators))), F.lit(name))


def node_paths(sub: DataFrame, end: bool = True) -> DataFrame:
    return _made(sub, F.concat(encode(F.col("path")), F.lit(":"), "node") if end else encode(F.col("path")))


def _code(text: Column, begun: Column | None = None) -> Column:
    """The polynomial hash of a text, or of one that goes on after a text with the hash begun, as an unsigned 32-bit number."""
    return F.aggregate(F.split(text, ""), F.lit(0).cast("long") if begun is None else begun, lambda h, c: (h * 31 + F.ascii(c)).bitwiseAND(F.lit(4294967295)))


def _bucket(code: Column, size: int) -> Column:
    return F.pmod(F.when(code >= 2147483648, code - 4294967296).otherwise(code), F.lit(size))


def hashed(features: DataFrame, size: int) -> DataFrame:
    """hash-n: the feature's polynomial hash (31, 32-bit, signed) by size; collisions become one feature."""
    return features.select("iid", F.concat(F.lit("hash-"), _bucket(_code(F.col("feature")), size).cast("string")).alias("feature")).distinct()


def with_bias(features: DataFrame) -> DataFrame:
    return features.unionAll(features.select("iid").distinct().select("iid", F.lit("bias").alias("feature")))


def matrix_text(features: DataFrame, inst: DataFrame) -> DataFrame:
    """A row of text for each instance that has a feature: f,1.0 -#- g,1.0 in order."""
    line = features.groupBy("iid").agg(F.array_join(F.transform(F.sort_array(F.collect_set("feature")), lambda f: F.concat(f, F.lit(",1.0"))), " -#- ").alias("row"))
    return line.join(inst.select("iid", "label"), "iid").select("iid", "label", "row")


def names(features: DataFrame) -> DataFrame:
    """(id, feature): features by position, from 1 in order of name; 0 stands for none."""
    return numbered(features.select("feature").distinct(), ["feature"], name="id").select("id", "feature")


PAIR = {"PraFeatureExtractor": pra, "PraFeatureExtractorWithFilter": pra, "OneSidedPathAndEndNodeFeatureExtractor": one_sided, "OneSidedFeatureExtractor": one_sided, "OneSidedPathOnlyFeatureExtractor": lambda s, i: one_sided(s, i, False), "CategoricalComparisonFeatureExtractor": categorical, "NumericalComparisonFeatureExtractor": numerical, "PathBigramsFeatureExtractor": bigrams, "VectorSimilarityFeatureExtractor": vector_similar, "AnyRelFeatureExtractor": any_relation, "AnyRelAliasOnlyFeatureExtractor": lambda s, i: any_relation(s, i, "@ALIAS@"), "ConnectedAtOneFeatureExtractor": connected, "ConnectedByMediatorFeatureExtractor": mediated}
NODE = {"PathAndEndNodeFeatureExtractor": node_paths, "PathOnlyFeatureExtractor": lambda s: node_paths(s, False)}

#: Extractors that read only the paths that join a pair.
JOINING = [k for k, f in PAIR.items() if f in (pra, bigrams, vector_similar, any_relation, connected, mediated)] + ["AnyRelAliasOnlyFeatureExtractor"]


def extractor(name: str, nodes: bool = False):
    try:
        return (NODE if nodes else PAIR)[name]
    except KeyError:
        raise ValueError(f"unknown feature extractor: {name}") from None
