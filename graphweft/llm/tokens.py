"""Whole-text encoding through the tokenizers and sentencepiece libraries, with a cache of encoded pieces."""

from __future__ import annotations

import os
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .shared import claim

#: Pieces that a worker keeps; later ones are encoded each time they come, so memory is bounded and results are the same.
CACHE_PIECES = 1_200_000
#: Bytes of text that are encoded at once: distinct pieces are looked up once for all of them.
TEXT_BYTES = 1 << 21


class Encoder:
    """ids of whole texts, exactly as the library gives them for the whole text.

    A text is cut at single spaces, where no token of the two tokenizer kinds can cross: with word ends, white
    space is dropped; with byte-level pieces, a space before other text begins a piece. Each distinct piece goes
    through the library once and is kept. Texts that have white space other than that between pieces
    (byte-level only), and all texts of other tokenizers, go through the library whole."""

    def __init__(self, path: str, pieces: int = CACHE_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        self.most = pieces
        self.path, self.cache, self.first, self.stops = path, {}, {}, {}
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.kind, self.size = "whole", model.get_piece_size()
            self.library = lambda texts: model.encode(texts, num_threads=1)
        else:
            import json

            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            tok.no_truncation()
            tok.no_padding()
            self.tokenizer, self.size = tok, tok.get_vocab_size()
            self.library = lambda texts: [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            self.kind = kind(spec)
        self.dtype = np.uint16 if self.size <= 65536 else np.uint32

    def encode(self, texts: Iterable[str]) -> list[np.ndarray]:
        """ids of each text, in the smallest unsigned type that holds the vocabulary."""
        ids, at = self.column(pa.array(list(texts), pa.string()))
        return [ids[a:b] for a, b in zip(at.tolist(), at[1:].tolist())]

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of the texts of a column (null: empty), end to end, and where each text's begin."""
        flat, starts, lens, codes, bounds = self._pieces(texts)
        n = lens[codes]
        ends = np.cumsum(n)
        at = np.concatenate([[0], ends])[bounds]
        return flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts[codes] - (ends - n), n)], at

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """Number of ids of each text."""
        _, _, lens, codes, bounds = self._pieces(texts)
        return np.diff(np.concatenate([[0], np.cumsum(lens[codes])])[bounds])

    def _pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The texts as a sequence of codes, and the rows' bounds in it; code c stands for the lens[c] ids from starts[c] on of flat.
        Distinct pieces are looked up once a column; a text that can't be cut is a piece of its own."""
        if texts.null_count:
            texts = texts.fill_null("")
        rows = len(texts)
        if self.kind == "whole":
            found = [np.array(x, self.dtype).tobytes() for x in self.library(texts.to_pylist())]
            return *self._store(found), np.arange(rows), np.arange(rows + 1)
        spaced = pc.replace_substring(texts, "\n", " ") if self.kind == "word ends" else texts
        parts = pc.split_pattern(spaced, " ")
        bounds = np.asarray(parts.offsets).astype(np.int64)
        coded = parts.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        bounds = bounds - bounds[0]
        codes, names = np.array(coded.indices, np.int32), coded.dictionary.to_pylist()
        heads = np.zeros(0, np.int64)
        bad = np.zeros(rows, bool)
        if self.kind == "byte level":  # the first piece of a text has no space before it
            heads = bounds[:-1]
            inner = np.ones(len(codes), bool)
            inner[heads] = False
            used = np.zeros(len(names), bool)
            used[codes[inner]] = True
            begin, end = _blank_ends(coded.dictionary, names)
            cannot = begin | end
            bad = np.add.reduceat((cannot[codes] & inner).astype(np.int64), heads) > 0 if rows else bad
            bad |= end[codes[heads]] & (np.diff(bounds) > 1)
            wanted = used & ~cannot
        else:
            wanted = np.ones(len(names), bool)
        found = list(map(self.cache.get, names))
        for i in np.flatnonzero(~wanted).tolist():
            found[i] = b""
        missing = [i for i, x in enumerate(found) if x is None]
        if missing:
            new = self._new({names[i] for i in missing}, " " if self.kind == "byte level" else "")
            for i in missing:
                found[i] = new[names[i]]
        if self.kind == "byte level":
            whole = np.flatnonzero(bad).tolist()
            text = {i: texts[i].as_py() for i in whole}
            opening = [text[i] if i in text else names[c] for i, c in enumerate(codes[heads].tolist())]
            codes[heads] = len(found) + np.arange(rows)
            found += self._opening(opening)
            if whole:  # the pieces of such a text after the first stand for nothing
                rest = inner & np.repeat(bad, np.diff(bounds))
                codes[rest] = len(found)
                found.append(b"")
        return *self._store(found), codes, bounds

    def _store(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat = np.frombuffer(b"".join(found), self.dtype)
        lens = np.fromiter(map(len, found), np.int64, len(found)) // self.dtype().itemsize
        return flat, np.cumsum(lens) - lens, lens

    def _opening(self, texts: list[str]) -> list[bytes]:
        """ids of texts or their first pieces, through the library; short ones are kept."""
        got = [self.first.get(t) for t in texts]
        new = list({t for t, x in zip(texts, got) if x is None})
        made = {t: np.array(x, self.dtype).tobytes() for t, x in zip(new, self.library(new))} if new else {}
        if len(self.first) < self.most // 10:
            self.first.update((t, x) for t, x in made.items() if len(t) <= 64)
        return [made[t] if x is None else x for t, x in zip(texts, got)]

    def _new(self, missing: set[str], prefix: str) -> dict[str, bytes]:
        """ids of pieces that are not kept. A comma or full stop after a letter begins a token in both kinds,
        so the two parts are encoded apart and the word alone is kept."""
        cache, ends = self.cache, {p for p in missing if len(p) > 1 and p[-1] in ",." and p[-2].isascii() and p[-2].isalpha()}
        bare = {p[:-1] for p in ends}
        pieces = [p for p in (missing - ends) | bare if p not in cache]
        got = {p: np.array(ids, self.dtype).tobytes() for p, ids in zip(pieces, self.library([prefix + p for p in pieces]))}
        if len(cache) < self.most:
            cache.update(got)
        if ends and not self.stops:
            self.stops = {c: np.array(ids, self.dtype).tobytes() for c, ids in zip(",.", self.library([",", "."]))}
        for p in ends:
            got[p] = (got.get(p[:-1]) or cache[p[:-1]]) + self.stops[p[-1]]
        return got


#: White space of one byte, as str.isspace() has it.
_BLANK = np.array([chr(i).isspace() for i in range(128)] + [False] * 128)


def _blank_ends(texts: pa.StringArray, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Which texts begin and which end with white space; empty ones do both. names: the same texts."""
    _, at, data = texts.buffers()
    at = np.frombuffer(at, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data, some = np.frombuffer(data or b"", np.uint8), np.flatnonzero(np.diff(at))
    out = []
    for place, char in ((at[:-1], 0), (at[1:] - 1, -1)):
        blank, edge = np.ones(len(texts), bool), data[place[some]]
        blank[some] = _BLANK[edge]
        for i in some[edge > 127].tolist():
            blank[i] = names[i][char].isspace()
        out.append(blank)
    return out[0], out[1]


def kind(spec: dict) -> str:
    """Which cuts are safe for a tokenizer file: only the two kinds whose rules are known, else none."""
    model, norm, pre = spec.get("model") or {}, spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    plain = all(" " not in t["content"] and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in spec.get("added_tokens") or ())
    if model.get("type") != "BPE" or model.get("dropout") or not plain or spec.get("post_processor"):
        return "whole"
    if not norm and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return "byte level"
    steps = [x.get("type") for x in norm.get("normalizers", ())]
    pattern = ((pre.get("pretokenizers") or [{}])[0].get("pattern") or {}).get("Regex", "")
    if steps == ["NFC", "Replace", "Lowercase"] and model.get("end_of_word_suffix") and pattern.endswith(r"[^\s\p{L}\p{N}]+") and r"\s*" not in pattern:
        return "word ends"
    return "whole"


def ended(ids: np.ndarray, at: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """ids of texts end to end, each followed by end_id."""
    return np.insert(ids, at[1:], end_id), at + np.arange(len(at))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str, pieces: int = CACHE_PIECES) -> Encoder:
    """One for each Python worker; another file takes its place."""
    claim(f"tokens {path}", _ENCODERS.clear)
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path, pieces)
    return _ENCODERS[path]


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
