"""Every query of the subpackage over the driver's smallest tables, all of whose columns are compared with a plain version."""

import hashlib
import os
import re
import zlib

import numpy as np
import pytest

from graphweft.llm import oracle, queries, tokens, toxicity

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver's tables")
WORD, BYTE = tokens.public_path("word_bpe_49k.json"), tokens.public_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def library(path, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    return tok, [e.ids for e in tok.encode_batch(list(texts), add_special_tokens=False)]


@pytest.mark.parametrize("name", sorted(oracle.ORACLE_SQL))
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(oracle.ORACLE_SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert sorted(map(str, got[cols].itertuples(index=False, name=None))) == sorted(map(str, want[cols].itertuples(index=False, name=None)))


def test_packing(spark, documents):
    rows = queries.QUERIES["op1_packing"](spark, SF).collect()
    _, ids = library(BYTE, documents.values())
    by, seqs = {}, {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
        seqs.setdefault(r["sequence_id"], []).append(r)
    for i, x in zip(documents, ids):
        x = np.array([*x, 1], "<u4")
        at = 0
        for r in sorted(by.pop(i), key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(x)) and r["ids_crc32"] == zlib.crc32(x[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(x)
    assert not by
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert sum(r["length"] for r in rows) > 0.95 * 2048 * len(seqs)


def test_round_trip(spark, documents):
    tok, ids = library(WORD, documents.values())
    want = {(i, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(tok.decode(x, skip_special_tokens=False).encode()).hexdigest()) for i, x in zip(documents, ids)}
    assert {tuple(r) for r in queries.QUERIES["op6_bpe"](spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()} == want


def test_arrow_files(spark, documents):
    at, want = 0, set()
    _, ids = library(WORD, [documents[i] for i in sorted(documents)])
    for i, x in zip(sorted(documents), ids):
        x = np.array([*x, 1], "<u4")
        want.add((i, at, len(x), zlib.crc32(x.tobytes())))
        at += len(x)
    assert {tuple(r) for r in queries.QUERIES["op7_arrow_file"](spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()} == want


def test_counts(spark, documents):
    _, ids = library(WORD, documents.values())
    want = {(i, len(documents[i].encode()), len(x), len(x) > 2048) for i, x in zip(documents, ids)}
    for _ in range(2):  # the second time from the cache
        assert {tuple(r) for r in queries.QUERIES["op8_token_counts"](spark, SF).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()} == want


def test_neighbours(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    good = [r for r in rows if r["embedding"] and all(v is not None and np.isfinite(v) for v in r["embedding"]) and any(r["embedding"])]
    ids, x = np.array([r["vec_id"] for r in good]), np.array([r["embedding"] for r in good], float)
    got = {}
    for r in queries.QUERIES["op5_multi_index"](spark, SF).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {int(i) for i in ids if i % 20 == 0}
    hits = 0
    place = {int(v): k for k, v in enumerate(ids)}
    for q, found in got.items():
        s = x @ x[place[q]]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and [(-f[2], f[1]) for f in found] == sorted((-f[2], f[1]) for f in found)
        assert all(abs(s[place[v]] - w) < 1e-9 for _, v, w in found)
        s[place[q]] = -np.inf
        hits += len({int(ids[k]) for k in np.lexsort((ids, -s))[:20]} & {f[1] for f in found})
    assert hits >= 0.9 * 20 * len(got)


def test_toxicity(spark, documents):
    rows = queries.QUERIES["op9_toxicity"](spark, SF).collect()
    assert {r["doc_id"] for r in rows} == set(documents) and len(rows) == len(documents)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)


def test_secrets(spark, documents):
    """Base spans by Python's own expressions, leftmost and not overlapping."""
    kinds = [("assign", r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", 2, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24)]
    for r in queries.QUERIES["op10_secrets"](spark, SF).collect():
        found = [(m.start(), k, name, m.end()) for k, (name, p, group, least) in enumerate(kinds) for m in re.finditer(p, documents[r["doc_id"]]) if len(m.group(group)) >= least]
        line = ",".join(f"{name}:{a}:{b}" for a, _, name, b in sorted(found))
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(f[1] == k for f in found) for k in range(3)]
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert set(filter(None, line.split(","))) <= set(r["spans"].split(","))


def test_characters_beyond_sixteen_bits(spark):
    from graphweft.llm import secrets

    text = "🙂é token='Ab3dEf9hIj' 🙂 0123456789abcdef01234567 Zk3LmP9qRs7TuVw2xYz81Ab🙂"
    r = secrets.scan(spark.createDataFrame([(1, text, "o")], "doc_id long, text string, source string")).first()
    assert [text[x["start"] : x["end"]] for x in r["spans"]] == ["token='Ab3dEf9hIj", "0123456789abcdef01234567", "Zk3LmP9qRs7TuVw2xYz81Ab"]


def test_frequencies_by_recount(spark):
    """Owners and repositories of each value, counted again in Python."""
    from pyspark.sql import functions as F

    from graphweft.llm import secrets

    rng = np.random.default_rng(3)
    values = [f"Qr7{i}LmN4pXz9kT{i}" for i in range(6)]
    rows = [(i, f"password={values[rng.integers(0, 6) if i % 3 else 0]}", f"o{rng.integers(0, 2 + i % 5)}", f"l{rng.integers(0, 3)}") for i in range(80)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    for r in secrets.scan(table, "source", F.concat_ws("/", "source", "lang")).collect():
        own = rows[r["doc_id"]][1]
        owners = {o for _, t, o, _ in rows if t == own}
        repos = {(o, lang) for _, t, o, lang in rows if t == own}
        (x,) = r["spans"]
        assert (x["owners"], x["repos"], x["live"]) == (len(owners), len(repos), len(owners) < secrets.COPIED_OWNERS and len(repos) < secrets.COPIED_REPOSITORIES)


def test_isotonic_is_least_squares():
    """Pooling gives the rising values with the least squared error, found by brute force over means of stretches."""
    rng = np.random.default_rng(8)
    for _ in range(20):
        s, y = rng.permutation(12).astype(float), (rng.random(12) < 0.4).astype(float)
        x, p = toxicity.isotonic(s, y)
        order = np.argsort(s)
        want = [max(min(y[order][a:b].mean() for b in range(i + 1, 13)) for a in range(i + 1)) for i in range(12)]  # max-min formula
        assert np.allclose(np.interp(np.sort(s), x, p), want)


def test_trees_split_where_the_gain_is_largest():
    """The first split of the first tree against all cuts of all features."""
    rng = np.random.default_rng(5)
    x = rng.random((200, 4)).round(2)
    y = ((x[:, 2] > 0.6) ^ (rng.random(200) < 0.1)).astype(float)
    model = toxicity.Trees(x, y)
    split, _ = model.trees[0]
    j, cut = split[0][0]
    q = np.full(200, y.mean())
    g, h = y - q, q * (1 - q)

    def gain(j, c):
        left = x[:, j] <= c
        return g[left].sum() ** 2 / (h[left].sum() + 1) + g[~left].sum() ** 2 / (h[~left].sum() + 1) - g.sum() ** 2 / (h.sum() + 1)

    best = max(gain(j, c) for j in range(4) for c in model.cuts[j])
    assert j == 2 and abs(gain(j, model.cuts[j][cut]) - best) < 1e-9
    assert ((model.score(x) > 0) == (y > 0)).mean() > 0.95
