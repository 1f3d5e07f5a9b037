"""Byte-pair encoding by backtracking over longest matches, and decoding through an offset table (operator 6)."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .shared import claim, slices, table, text_bytes
from .tokens import public_path

#: Words and white-space separated pieces that a worker keeps.
CACHE_WORDS, CACHE_PIECES = 400_000, 400_000
_END = 256  # added to the last byte of a word: a symbol of its own


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Backtracking:
    """Encodes as the merge rules do, in time linear in the text.

    A word is a string of symbols (a byte; the last one plus 256). Matching goes over an Aho-Corasick automaton of the
    tokens; the longest token at a position is taken if it is compatible with the token before, else the next shorter
    prefix, else the token before is taken back and its end is marked as a dead end. Two tokens are compatible if
    merging, undone step by step from the later merge, never meets a merge across their border that would have come
    first; the answers are kept in a table."""

    def __init__(self, path: str):
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model.get("end_of_word_suffix") or ""
        if model["type"] != "BPE" or model.get("dropout") or not suffix or spec.get("decoder") or model.get("unk_token"):
            raise ValueError(f"not a BPE file with word ends: {path}")
        letters = {c: b for b, c in enumerate(byte_letters())}

        def symbols(token: str) -> str:
            ended = token.endswith(suffix)
            codes = [letters[c] for c in (token[: -len(suffix)] if ended else token)]
            if ended:
                codes[-1] += _END
            return "".join(map(chr, codes))

        vocab: dict[str, int] = model["vocab"]
        specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens with options are not supported")
        self.specials = specials
        self.special = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.pretoken = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        # Ranks: a symbol is its own (-1 - id), a merge the place of its rule.
        self.merge: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        for place, rule in enumerate(model["merges"]):
            left, right = rule if isinstance(rule, list) else rule.split(" ")
            token = vocab[left + right]
            pair = vocab[left], vocab[right]
            if pair not in self.merge:
                self.merge[pair] = place
            if token not in self.halves:
                self.halves[token], self.rank[token] = pair, place
        self.id_of = {symbols(t): i for t, i in vocab.items() if t not in specials}
        self.text_of = {i: s for s, i in self.id_of.items()}
        # Only tokens that encoding their own symbols gives can ever be taken.
        self.compatible: dict[tuple[int, int], bool] = {}
        sound = set()
        for i in sorted(self.text_of, key=lambda i: self.rank.get(i, -1)):
            pair = self.halves.get(i)
            if pair is None or (pair[0] in sound and pair[1] in sound and self._pair(*pair, self.rank[i])):
                sound.add(i)
        self.sound = sound
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for s, i in self.id_of.items():
            if i in sound:
                self.automaton.add_word(s, i)
        self.automaton.make_automaton()
        self.shorter: dict[int, int | None] = {}
        for i in sound:
            s = self.text_of[i]
            self.shorter[i] = next((j for n in range(len(s) - 1, 0, -1) if (j := self.id_of.get(s[:n])) is not None and j in sound), None)
        self.length = {i: len(s) for i, s in self.text_of.items()}
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        # Decoding: all tokens' texts in one row of bytes, each with a space behind, and where they begin.
        size = max([*vocab.values(), *specials.values()]) + 1
        texts = [b""] * size
        for t, i in {**vocab, **specials}.items():
            texts[i] = t.encode() + b" "
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)
        self.begin = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        self.dtype = np.uint16 if size <= 65536 else np.uint32

    def _pair(self, a: int, b: int, before: int | None = None) -> bool:
        """Whether a and b stay apart when their symbols are merged together (before: by the rules up to that place)."""
        limit = len(self.merge) if before is None else before
        while True:
            place = self.merge.get((a, b))
            if place is not None and place < limit:
                return False
            ra, rb = self.rank.get(a, -1), self.rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            # Undo the later of the two merges. A merge of equal place comes first on the left, so on a tie the right one goes.
            if ra > rb:
                limit, a = min(limit, ra), self.halves[a][1]
            else:
                limit, b = min(limit, rb + 1), self.halves[b][0]

    def _fits(self, a: int, b: int) -> bool:
        got = self.compatible.get((a, b))
        if got is None:
            got = self._pair(a, b)
            if len(self.compatible) < 2_000_000:
                self.compatible[a, b] = got
        return got

    def word(self, raw: bytes) -> bytes:
        """ids of one word."""
        s = raw[:-1].decode("latin-1") + chr(raw[-1] + _END)
        whole = self.id_of.get(s)
        if whole in self.sound:
            return np.array([whole], self.dtype).tobytes()
        n = len(s)
        longest: list[int] = [-1] * n
        size = self.length
        for end, i in self.automaton.iter(s):
            at = end - size[i] + 1
            if longest[at] < 0 or size[i] > size[longest[at]]:
                longest[at] = i
        out: list[int] = []
        dead = bytearray(n + 1)
        at, now = 0, longest[0]
        while at < n:
            last = out[-1] if out else None
            take: int | None = now
            while take is not None:
                end = at + size[take]
                if not dead[end] and (last is None or self._fits(last, take)):
                    break
                take = self.shorter[take]
            if take is not None:
                out.append(take)
                at = end
                if at < n:
                    now = longest[at]
            else:
                dead[at] = 1
                now = out.pop()
                at -= size[now]
        return np.array(out, self.dtype).tobytes()

    def _normal(self, text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        return text.lower() if text.isascii() or "Σ" not in text else "".join(c.lower() for c in text)

    def _plain(self, text: str) -> bytes:
        out = []
        for m in self.pretoken.findall(self._normal(text)):
            ids = self.words.get(m)
            if ids is None:
                ids = self.word(m.encode())
                if len(self.words) < CACHE_WORDS:
                    self.words[m] = ids
            out.append(ids)
        return b"".join(out)

    def _piece(self, piece: str) -> bytes:
        if self.special is None or "<" not in piece and not self.special.search(piece):
            return self._plain(piece)
        out, at = [], 0
        for m in self.special.finditer(piece):
            out += [self._plain(piece[at : m.start()]), np.array([self.specials[m[0]]], self.dtype).tobytes()]
            at = m.end()
        return b"".join([*out, self._plain(piece[at:])])

    def encode(self, text: str) -> np.ndarray:
        """ids of a whole text. No word, special token or composed letter goes across a space or a line break."""
        cache, out = self.pieces, []
        for p in text.replace("\n", " ").split(" "):
            ids = cache.get(p)
            if ids is None:
                ids = self._piece(p)
                if len(cache) < CACHE_PIECES:
                    cache[p] = ids
            out.append(ids)
        return np.frombuffer(b"".join(out), self.dtype)

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The text of each row of ids, as UTF-8: the tokens' texts with spaces between, gathered by offset."""
        flat = np.concatenate(ids).astype(np.int64) if ids else np.zeros(0, np.int64)
        size = self.begin[flat + 1] - self.begin[flat]
        ends = np.concatenate([[0], np.cumsum(size)])
        where = np.arange(ends[-1]) + np.repeat(self.begin[flat] - ends[:-1], size)
        text = self.bytes[where].tobytes()
        rows = np.cumsum([0, *map(len, ids)])
        return [text[ends[a] : max(ends[a], ends[b] - 1)] for a, b in zip(rows, rows[1:])]


_MODELS: dict[str, Backtracking] = {}


def model(path: str) -> Backtracking:
    claim(f"bpe {path}", _MODELS.clear)
    if path not in _MODELS:
        _MODELS[path] = Backtracking(path)
    return _MODELS[path]


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (unsigned 32-bit little-endian binary), decoded (UTF-8 binary) of every whole text.

    A null or empty text has no ids and decodes to an empty text; equal rows each give a row; an empty table gives
    an empty result; columns other than doc_id and text are not read. No shuffle: a task holds about 1 MB of text at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        for batch in batches:
            _, at = text_bytes(batch.column(1))
            for a, b in slices(at, 1 << 20):
                part = batch.slice(a, b - a)
                ids = [bpe.encode(x or "") for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), pa.array(bpe.decode(ids), pa.binary())], names=["doc_id", "ids", "decoded"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, ids binary, decoded binary")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = round_trip(table(spark, sf_dir, "documents"), public_path("word_bpe_49k.json"))
    return out.selectExpr("doc_id", "cast(octet_length(ids) div 4 as long) n_tokens", "sha2(ids, 256) ids_sha256", "sha2(decoded, 256) decoded_sha256")
