"""Secret scans with corpus-wide ownership frequency (operator 10): SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import nested, table, text_hash, unnested, written

# The kinds in their order, their patterns (Java; letters of assign in either ASCII case),
# the group that is the secret, and its least length.
KINDS = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
    ("opaque", r"[A-Za-z0-9+/_-]{20,}", 0, 20),
]
#: From so many owners or repositories on, a value is a widely copied example and no credential of anyone.
COPIED_OWNERS, COPIED_REPOSITORIES = 3, 4
SALTS = 16


def _found(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Matches, leftmost and not overlapping, as structs in code points. The text between matches and the matches
    themselves give the places, so no mark has to be put into the text."""
    whole, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    rows = F.arrays_zip(whole.alias("m"), F.slice(gaps, 1, F.size(whole)).alias("gap"), value.alias("v"))
    empty = F.expr("struct(0L as at, cast(array() as array<struct<start:bigint,end:bigint,value:string>>) as got)")

    def step(acc, x):
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["m"])
        one = F.struct(begin.cast("long").alias("start"), end.cast("long").alias("end"), x["v"].alias("value"))
        return F.struct(end.cast("long").alias("at"), F.when(F.length(x["v"]) >= least, F.concat(acc["got"], F.array(one))).otherwise(acc["got"]).alias("got"))

    placed = F.aggregate(rows, empty, step, lambda acc: acc["got"])
    # A cheap test first: most texts have no match that is long enough.
    test = {"hex": r"[0-9a-f]{24}", "access": r"AKIA[A-Z0-9]{16}"}.get(kind, pattern)
    return F.when(F.regexp_like(text, F.lit(test)), placed).otherwise(F.expr("cast(array() as array<struct<start:bigint,end:bigint,value:string>>)"))


def _live(value: Column) -> Column:
    """Looks like a credential: letters and digits, some variety, and none of the usual fillers."""
    distinct = F.size(F.array_distinct(F.split(F.lower(value), "")))
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (distinct >= 7) & ~F.lower(value).rlike("example|sample|dummy|changeme|placeholder|xxxx|0123456|abcdef")


def scan(docs: DataFrame, owner: str = "source", repository: Column | None = None, copied_owners: int = COPIED_OWNERS, copied_repositories: int = COPIED_REPOSITORIES) -> DataFrame:
    """Every row of docs (its id in doc_id, other columns kept aside) with the spans found in its whole text.

    Columns: rid (row key), doc_id, th (hash of the text), base (spans of the first three kinds) and spans (all: base and those that the
    ownership count adds), arrays of (start, place, kind, end, live) in order. A value's hash is counted by
    distinct repositories and owners over the whole corpus: from copied_owners owners or copied_repositories repositories on
    it is an example. An opaque string outside the base spans is added if it looks live and is held by fewer of both. Null
    text is empty; a null owner is an owner of its own; a null doc_id stays null; equal rows are scanned each for itself, and
    copies under one owner are that owner's; an empty table gives an empty result."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    repo = repository if repository is not None else F.col(owner)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.col(owner).cast("string"), F.lit("\0")).alias("owner"), F.coalesce(repo.cast("string"), F.lit("\0")).alias("repo"))
    found = rows.select("rid", "doc_id", F.xxhash64("text").alias("th"), "owner", "repo", *[_found(F.col("text"), *k).alias(k[0]) for k in KINDS])

    def of_kind(place):
        return lambda x: F.struct(x["start"].alias("start"), F.lit(place).alias("place"), F.lit(KINDS[place][0]).alias("kind"), x["end"].alias("end"), x["value"].alias("value"))

    base = F.flatten(F.array(*[F.transform(KINDS[i][0], of_kind(i)) for i in range(3)]))
    found = written(found.select("rid", "doc_id", "th", "owner", "repo", F.sort_array(base).alias("base"), "opaque"), "secrets")
    outside = F.filter("opaque", lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])) & _live(x["value"]))
    extra = F.transform(outside, of_kind(3))
    one = found.select("rid", "owner", "repo", F.explode(F.concat("base", extra)).alias("x"))
    one = written(one.select("rid", "owner", "repo", "x.start", "x.place", "x.kind", "x.end", F.sha2("x.value", 256).alias("hash"), _live(F.col("x.value")).alias("looks")), "candidates")
    # Frequency: one row for each value and holder first, so a value that a third of all rows hold is small before it meets itself.
    held = one.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n")).groupBy("hash", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    held = held.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"), F.sum("n").alias("n"))
    held = held.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    judged = one.withColumn("salt", F.pmod("rid", F.lit(SALTS)).cast("int")).join(held.hint("merge"), ["hash", "salt"])  # salted copies grow with the data: never broadcast
    judged = judged.withColumn("live", F.col("looks") & (F.col("owners") < copied_owners) & (F.col("repos") < copied_repositories)).where((F.col("place") < 3) | F.col("live"))
    spans = judged.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", "place", "kind", "end", "live", "owners", "repos"))).alias("spans"))  # of one document
    none = F.expr("cast(array() as array<struct<start:bigint,place:int,kind:string,end:bigint,live:boolean,owners:bigint,repos:bigint>>)")
    return found.select("rid", "doc_id", "th", "base").join(spans, "rid", "left").select("rid", "doc_id", "th", "base", F.coalesce("spans", none).alias("spans"))


def _line(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents: the owner is the source, a repository its documents of one language; the cases of scan()."""
    docs = table(spark, sf_dir, "documents")
    out = scan(docs, "source", F.concat_ws("/", "source", "lang"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    live = F.size(F.filter("spans", lambda x: x["live"])).cast("long").alias("n_live")
    return out.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_line("base"), 256).alias("base_sha256"), _line("spans").alias("spans"), live)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking values of one owner are replaced in the text; examples that many owners copy stay. All rows and columns
    stay, n_chars is counted anew where a text changes. Rows are matched by doc_id (null as a value of its own) and the hash
    of their text, so rows that repeat both are alike; null and empty texts are unchanged; an empty table gives an empty one;
    columns may have any name."""
    live = scan(docs, "source", F.concat_ws("/", "source", "lang")).select("doc_id", "th", F.filter("spans", lambda x: x["live"]).alias("live")).where(F.size("live") > 0)
    live = live.groupBy(F.col("doc_id").alias("of_doc"), F.col("th").alias("of_th")).agg(F.min("live").alias("live")).hint("merge")  # grows with the data: never broadcast
    start = F.expr("struct(0L as at, '' as made)")

    def cut(acc, x):
        skip = x["start"] < acc["at"]
        upto = F.greatest(x["end"], acc["at"])
        return F.struct(upto.alias("at"), F.when(skip, acc["made"]).otherwise(F.concat(acc["made"], F.substring("text", (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int")), F.lit("[SECRET]"))).alias("made"))

    clean = F.aggregate("live", start, cut, lambda acc: F.concat(acc["made"], F.substring("text", (acc["at"] + 1).cast("int"), F.length("text"))))
    rows = nested(docs, "doc_id", "text").withColumn("th", text_hash(F.col("text")))
    out = rows.join(live, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("th") == F.col("of_th")), "left")
    changed = F.col("live").isNotNull()
    out = out.withColumn("text", F.when(changed, clean).otherwise(F.col("text")))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("text").cast("long")).otherwise(F.col("row")["n_chars"])
    return unnested(out, docs, new)
