"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration (operator 9)."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import claim, nested, slices, table, text_bytes, tidy, unnested, written

#: Labelled rows that the model learns from, at most: those with the smallest hash of doc_id.
TRAIN_ROWS = 16384
#: Entries of the learned lexicon, at most; documents that must hold one; how much commoner it must be in toxic ones.
LEXICON, LEAST_DOCUMENTS, LEAST_RATIO = 4096, 3, 12.0
FOLDS, TREES, DEPTH, RATE, BINS = 4, 60, 3, 0.15, 32
REJECT = 0.3

# Insults that any corpus may hold, and pronouns of the second person (English, French, German, Spanish).
INSULTS = "asshole bastard bitch clown coward creep disgusting dumb fool freak garbage hate idiot imbecile jerk liar loser lunatic moron pathetic pig scum shit stupid trash ugly vermin worthless".split()
SECOND = set("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine deinen ihr euch euer usted ustedes ti tú vosotros os".split())
FEATURES = ["words", "hits", "density", "kinds", "strongest", "weight", "insults", "second", "near", "capitals", "shouted", "exclaimed", "asked", "punctuation", "obfuscated", "unmasked"]

_WORD = re.compile(r"[^\W\d_]+")
_MASKED = re.compile(r"(?<!\w)[^\W\d_]+[0-9@$*!|+]+[^\W\d_]+(?!\w)")
_LEET = str.maketrans("013457@$!|+", "oieastasilt")
_SHOUT = re.compile(r"\b[A-Z]{3,}\b")


def grams(word: str) -> tuple[str, ...]:
    """A word and its first four and five letters; prefixes are marked."""
    return (word, word[:4] + "*", word[:5] + "*") if len(word) > 5 else (word, word[:4] + "*") if len(word) > 4 else (word,)


class Featurizer:
    """Dense features of a text, given a lexicon (gram: log of how much commoner in toxic documents)."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.known = lexicon, {}

    def weight(self, word: str) -> float:
        got = self.known.get(word)
        if got is None:
            got = max((self.lexicon.get(g, 0.0) for g in grams(word)), default=0.0)
            if len(self.known) < 100_000:
                self.known[word] = got
        return got

    def __call__(self, text: str, raw: np.ndarray) -> list[float]:
        words = _WORD.findall(text.lower())
        n = max(1, len(words))
        kinds = set(words)
        bad = {w: x for w in kinds if (x := self.weight(w)) > 0}
        hits = weight = insults = 0
        near = 0.0
        second = sum(map(words.count, kinds & SECOND)) if kinds & SECOND else 0
        if bad or not kinds.isdisjoint(INSULTS):
            at = [i for i, w in enumerate(words) if w in bad]
            hits, weight = len(at), sum(bad[words[i]] for i in at)
            insults = sum(words.count(w) for w in kinds.intersection(INSULTS))
            to = np.array([i for i, w in enumerate(words) if w in SECOND])
            if len(to) and at:
                near = 1.0 / max(1, min(int(np.abs(to - i).min()) for i in at))
        masked = _MASKED.findall(text)
        unmasked = sum(1 for m in masked if self.weight(m.lower().translate(_LEET).replace("*", "")) > 0)
        seen = np.bincount(raw, minlength=256)
        letters = max(1, int(seen[65:91].sum() + seen[97:123].sum() + seen[128:].sum()))
        size = max(1, len(raw))
        return [
            math.log1p(len(words)), math.log1p(hits), hits / n, len(bad), max(bad.values(), default=0.0), weight / n, insults / n, second / n, near,
            seen[65:91].sum() / letters, len(_SHOUT.findall(text)) / n, seen[33] / size, seen[63] / size, (seen[33:48].sum() + seen[58:65].sum()) / size, len(masked) / n, unmasked,
        ]


def _features(column: pa.Array, of: list[Featurizer]) -> np.ndarray:
    raw, at = text_bytes(column)
    return np.array([f(t or "", raw[a:b]) for f, t, a, b in zip(of, column.to_pylist(), at, at[1:])], float).reshape(-1, len(FEATURES))


class Trees:
    """Boosted regression trees on the logistic loss, over binned features. Ties between splits go to the first feature and bin."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        # Rare values matter here: cuts between the quantiles of what is not the commonest value.
        for j, c in enumerate(self.cuts):
            values, n = np.unique(x[:, j], return_counts=True)
            rest = x[x[:, j] != values[n.argmax()], j]
            if len(rest):
                self.cuts[j] = np.unique(np.concatenate([c, np.quantile(rest, np.linspace(0, 1, BINS // 2)), [values[n.argmax()]]]))
        b = self.binned(x)
        p = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.start, self.trees = float(np.log(p / (1 - p))), []
        f = np.full(len(y), self.start)
        width = max(len(c) for c in self.cuts) + 1
        for _ in range(TREES):
            q = 1 / (1 + np.exp(-f))
            g, h = y - q, q * (1 - q)
            node = np.zeros(len(y), np.int64)
            split = []
            for level in range(DEPTH):
                k = 1 << level
                best = np.full(k, 1e-9)
                pick = np.full((k, 2), -1)
                for j in range(b.shape[1]):
                    key = node * width + b[:, j]
                    G = np.bincount(key, g, k * width).reshape(k, width).cumsum(1)
                    H = np.bincount(key, h, k * width).reshape(k, width).cumsum(1)
                    tg, th = G[:, -1:], H[:, -1:]
                    gain = G**2 / (H + 1) + (tg - G) ** 2 / (th - H + 1) - tg**2 / (th + 1)
                    gain[(H < 0.5) | (th - H < 0.5)] = 0
                    at = gain.argmax(1)
                    better = gain[np.arange(k), at] > best + 1e-12
                    best[better] = gain[np.arange(k), at][better]
                    pick[better] = np.stack([np.full(k, j), at], 1)[better]
                split.append(pick)
                node = self._down(node, pick, b)
            k = 1 << DEPTH
            leaf = RATE * np.bincount(node, g, k) / (np.bincount(node, h, k) + 1)
            self.trees.append((split, leaf))
            f = f + leaf[node]

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(self.cuts)], 1)

    @staticmethod
    def _down(node: np.ndarray, pick: np.ndarray, b: np.ndarray) -> np.ndarray:
        j, cut = pick[node, 0], pick[node, 1]
        return node * 2 + ((j >= 0) & (b[np.arange(len(b)), np.maximum(j, 0)] > cut))

    def score(self, x: np.ndarray) -> np.ndarray:
        b, f = self.binned(x), np.full(len(x), self.start)
        for split, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for pick in split:
                node = self._down(node, pick, b)
            f += leaf[node]
        return f


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots of a rising function from scores to shares of label 1."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum, count, first score, last score
    for s, t in zip(score[order].tolist(), y[order].tolist()):
        blocks.append([t, 1, s, s])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            t2, n2, _, hi = blocks.pop()
            blocks[-1] = [blocks[-1][0] + t2, blocks[-1][1] + n2, blocks[-1][2], hi]
    x = [v for b in blocks for v in (b[2], b[3])]
    p = [b[0] / b[1] for b in blocks for _ in range(2)]
    return np.array(x), np.array(p)


class Model:
    def __init__(self, lexicon: dict[str, float], trees: Trees | None, knots: tuple[np.ndarray, np.ndarray] | None, constant: float = 0.0):
        self.lexicon, self.trees, self.knots, self.constant = lexicon, trees, knots, constant

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        """Between knots the score rises in a straight line; a thousandth of it follows the trees' own score, so ties are few."""
        return 0.999 * np.interp(raw, *self.knots) + 0.001 / (1 + np.exp(-raw))

    def scores(self, column: pa.Array, f: Featurizer) -> np.ndarray:
        if self.trees is None:
            return np.full(len(column), self.constant)
        return self.calibrated(self.trees.score(_features(column, [f] * len(column)))) if len(column) else np.zeros(0)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Learns from labelled rows that are not held out: the lexicon from counts of documents, the trees from features
    that use the lexicon of the other folds, the calibration from scores of the other folds' trees.

    A document with several labels is toxic if one says so; rows with a null id or label are left out; of rows that repeat a
    doc_id one is learned from. Without both labels the score is the share of label 1 (0 without rows)."""
    spark = docs.sparkSession
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).where("doc_id is not null and y is not null")
    chosen = chosen.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # At most TRAIN_ROWS pairs of numbers are broadcast, and as many texts are kept: of rows that repeat a doc_id, that with the least hash of its text.
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text"), "text")).getField("text").alias("text"))
    sample = written(found.select("doc_id", "y", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(FOLDS)).cast("int").alias("fold"), "text"), "toxicity-sample").repartition(12)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxicity")
        seen: dict[tuple[int, int], Counter] = {}
        for batch in batches:
            for y, fold, text in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                seen.setdefault((fold, y), Counter()).update({g for w in set(_WORD.findall(text.lower())) for g in grams(w)})
        for (fold, y), c in seen.items():
            names = list(c)
            for i in range(0, len(names), 50_000):
                part = names[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([fold] * len(part), pa.int32()), pa.array([y] * len(part), pa.int32()), pa.array(part), pa.array([c[g] for g in part], pa.int64())], names=["fold", "y", "gram", "n"])

    totals = {(r["fold"], r["y"]): r["count"] for r in sample.groupBy("fold", "y").count().collect()}
    counts = sample.mapInArrow(tidy(counted), "fold int, y int, gram string, n long")
    counts = counts.groupBy("gram").agg(*[F.sum(F.when((F.col("fold") == k) & (F.col("y") == y), F.col("n")).otherwise(0)).alias(f"n{k}{y}") for k in range(FOLDS) for y in (0, 1)])
    counts = counts.where(" + ".join(f"n{k}1" for k in range(FOLDS)) + f" >= {LEAST_DOCUMENTS}")
    n = {y: sum(v for (_, t), v in totals.items() if t == y) for y in (0, 1)}
    if not n[0] or not n[1]:
        return Model({}, None, None, float(n[1] > 0))
    toxic, clean = (F.expr(" + ".join(f"n{k}{y}" for k in range(FOLDS))) for y in (1, 0))
    counts = counts.where((toxic / F.lit(float(n[1]))) / ((clean + 0.5) / F.lit(float(n[0]))) >= LEAST_RATIO / 3).orderBy(toxic.desc(), "gram").limit(8 * LEXICON).collect()  # bounded

    def lexicon(without: int | None) -> dict[str, float]:
        use = [k for k in range(FOLDS) if k != without]
        of = {y: max(1, sum(totals.get((k, y), 0) for k in use)) for y in (0, 1)}
        found = []
        for r in counts:
            t, c = (sum(r[f"n{k}{y}"] for k in use) for y in (1, 0))
            ratio = ((t + 0.0) / of[1]) / ((c + 0.5) / of[0])
            if t >= LEAST_DOCUMENTS and ratio >= LEAST_RATIO:
                found.append((-t, r["gram"], math.log(ratio)))
        return {g: w for _, g, w in sorted(found)[:LEXICON]}

    lexica = [lexicon(k) for k in range(FOLDS)]

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxicity")
        of = [Featurizer(x) for x in lexica]
        for batch in batches:
            x = _features(batch.column(3), [of[k] for k in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["doc_id", "y", "fold", "x"])

    got = sorted(sample.mapInArrow(tidy(featured), "doc_id long, y int, fold int, x array<double>").collect(), key=lambda r: r["doc_id"])  # TRAIN_ROWS short rows
    x, y, fold = np.array([r["x"] for r in got]), np.array([r["y"] for r in got], float), np.array([r["fold"] for r in got])
    y = (y > 0).astype(float)
    out = np.zeros(len(y))
    for k in range(FOLDS):
        mine = fold == k
        if mine.any():
            rest = y[~mine]
            out[mine] = Trees(x[~mine], rest).score(x[mine]) if len(rest) and 0 < rest.sum() < len(rest) else 0.0
    return Model(lexicon(None), Trees(x, y), isotonic(out, y))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row's whole text; null texts are empty, and empty ones are scored too. Repeated rows each
    give a row; an empty table gives an empty result; columns other than doc_id and text are not read. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxicity")
        f = Featurizer(model.lexicon)
        for batch in batches:
            _, at = text_bytes(batch.column(1))
            for a, b in slices(at, 1 << 20):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.clip(model.scores(part.column(1), f), 0, 1))], names=["doc_id", "score"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "coalesce(cast(text as string), '') text").mapInArrow(tidy(run), "doc_id long, score double")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; the cases of train() and score(). A null doc_id is not held out."""
    docs = table(spark, sf_dir, "documents")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the limit, with all their columns, whatever their names. Null texts are scored as empty ones and
    stay null; repeated rows fare alike, and so do rows with a null doc_id; an empty table gives an empty one. Without labels nothing is
    rejected."""
    model = train(docs, table(spark, sf_dir, "labels"))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        claim("toxicity")
        f = Featurizer(model.lexicon)
        for batch in batches:
            _, at = text_bytes(batch)
            yield pa.concat_arrays([pa.array(model.scores(batch.slice(a, b - a), f) < REJECT, pa.bool_()) for a, b in slices(at, 1 << 20)]) if len(batch) else pa.array([], pa.bool_())

    rows = nested(docs, "text").select("row", F.coalesce("text", F.lit("")).alias("text"))
    return unnested(rows.where(F.arrow_udf(run, "boolean")("text")), docs)
