"""Byte-level BPE encoding by per-prefix dynamic programming, and decoding.

For every prefix of a word the encoding has one last token: a token that ends there (found by an
automaton over all tokens, which yields every suffix match) and is compatible with the last token
of the prefix before it. Two tokens are compatible when their joined bytes encode to just those
two. Following the stored lengths back from the end gives the ids. Words are cut by the usual
pattern and, once encoded, kept in a bounded cache of the task. No shuffle: one narrow
map over the scan, with memory bounded by an Arrow batch, one text and the cache.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import trim

#: Fixed values of the format: how text is cut before merging, and which bytes print as themselves.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PRINTABLE = (range(0x21, 0x7F), range(0xA1, 0xAD), range(0xAE, 0x100))
#: Words remembered by a task; the cache is emptied when it is full, which changes no result.
CACHE_WORDS = 400_000
CACHE_WORD_CHARS = 64

SCHEMA = "doc_id long, n_tokens long, ids binary, decoded string"


def byte_alphabet() -> dict[str, int]:
    """Character to byte: printable bytes stand for themselves, the others for U+0100 onwards."""
    own = [b for r in PRINTABLE for b in r]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Words(dict):
    """Words encoded before, up to CACHE_WORDS; others are encoded when they are asked for."""

    def __init__(self, bpe: Bpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = self.bpe.encode_word(word.encode("utf-8"))
        if len(word) <= CACHE_WORD_CHARS:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = found
        return found


class Bpe:
    """A byte-level BPE vocabulary of the tokenizers library's JSON."""

    def __init__(self, spec: dict):
        import ahocorasick
        import regex

        model, letters = spec["model"], byte_alphabet()
        pre = spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space") or spec.get("normalizer") or model.get("ignore_merges"):
            raise ValueError("only plain byte-level BPE files are read")
        in_bytes = lambda token: bytes(letters[c] for c in token)
        self.tokens: dict[int, bytes] = {}
        self.ids: dict[bytes, int] = {}
        for token, i in model["vocab"].items():
            if all(c in letters for c in token):
                self.tokens[i] = in_bytes(token)
                self.ids[self.tokens[i]] = i
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        merged = set()
        for r, pair in enumerate(model["merges"]):
            a, b = (in_bytes(x) for x in (pair if isinstance(pair, list) else pair.split(" ")))
            self.rank[self.ids[a], self.ids[b]] = (r, self.ids[a + b])
            merged.add(self.ids[a + b])
        self.made = {self.rank[p][1]: (self.rank[p][0], *p) for p in self.rank}  # token: rank, left part, right part
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if any(t.get("single_word") or t.get("lstrip") or t.get("rstrip") or t.get("normalized") for t in spec.get("added_tokens", [])):
            raise ValueError("only plain added tokens are read")
        self.pieces = dict(self.tokens) | {i: t.encode() for t, i in self.special.items()}
        self.words = regex.compile(PATTERN)
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.automaton = ahocorasick.Automaton()
        for token, i in self.ids.items():
            if i in merged or len(token) == 1:
                self.automaton.add_word(token.decode("latin-1"), (i, len(token)))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}
        self.cache = Words(self)

    def merge(self, raw: bytes) -> list[int]:
        """The defining procedure, for the few bytes of two tokens: always the lowest-ranked pair."""
        parts = [self.ids[raw[i : i + 1]] for i in range(len(raw))]
        while len(parts) > 1:
            found = [(self.rank[p][0], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in self.rank]
            if not found:
                break
            i = min(found)[1]
            parts[i : i + 2] = [self.rank[parts[i], parts[i + 1]][1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > 400_000:
                self.pairs.clear()
            known = self.pairs[key] = self.stays_apart(left, right)
        return known

    def stays_apart(self, left: int, right: int) -> bool:
        """Whether no merge ever crosses the border of two tokens side by side. Merges are undone from the
        last one backwards, on the part of either token that touches the border; a pair there that would
        have merged before the parts it needs were used up crosses it. Of equal ranks the left merge
        comes first."""
        rank, made = self.rank, self.made
        before = len(rank) + 1  # merges of lower rank find the two parts side by side
        while True:
            found = rank.get((left, right))
            if found is not None and found[0] < before:
                return False
            a, b = made.get(left), made.get(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and a[0] > b[0]):
                before, left = a[0], a[2]
            else:
                before, right = b[0] + 1, b[1]

    def whole(self, token: int) -> bool:
        """Whether the token's bytes encode to that token alone."""
        known = self.alone.get(token)
        if known is None:
            known = self.alone[token] = self.merge(self.tokens[token]) == [token]
        return known

    def encode_word(self, raw: bytes) -> tuple[int, ...]:
        """last[i] and length[i]: the last token of the encoding of raw[:i]. Linear in the word, as a
        position has at most as many matches as the longest token has bytes."""
        token = self.ids.get(raw)
        n = len(raw)
        if token is not None and self.whole(token):
            return (token,)
        last, length = [-1] * (n + 1), [0] * (n + 1)
        pairs, compatible, alone = self.pairs, self.compatible, self.alone
        for end, (token, size) in self.automaton.iter(raw.decode("latin-1")):
            i = end + 1
            if length[i]:
                continue  # matches at an end come longest first; one only is compatible
            if size == i:
                if alone.get(token) or self.whole(token):
                    last[i], length[i] = token, size
            elif (before := last[i - size]) >= 0:
                known = pairs.get(before << 32 | token)
                if known if known is not None else compatible(before, token):
                    last[i], length[i] = token, size
        out, i = [], n
        while i:
            out.append(last[i])
            i -= length[i]
        out.reverse()
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text; strings of added tokens in it become their ids."""
        word = self.cache.__getitem__
        if self.cut is None:
            return list(chain.from_iterable(map(word, self.words.findall(text))))
        out: list[int] = []
        for i, part in enumerate(self.cut.split(text) if any(s in text for s in self.special) else (text,)):
            if i % 2:
                out.append(self.special[part])
            elif part:
                out.extend(chain.from_iterable(map(word, self.words.findall(part))))
        return out

    def decode(self, ids: list[int]) -> str:
        """Special tokens are kept; bytes that are no UTF-8 become U+FFFD; unknown ids vanish."""
        return b"".join([self.pieces.get(i, b"") for i in ids]).decode("utf-8", "replace")


_LOADED: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    """The vocabulary of a file, read once."""
    if path not in _LOADED:
        with open(path, encoding="utf-8") as f:
            _LOADED[path] = Bpe(json.load(f))
    return _LOADED[path]


def from_text(spec: bytes) -> Bpe:
    """One vocabulary per Python worker and file; workers get the file's bytes, not its path."""
    key = hashlib.sha256(spec).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Bpe(json.loads(spec))
    return _LOADED[key]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pack(ids: list[int]) -> bytes:
    return np.asarray(ids, "<u4").tobytes()


def unpack(raw: bytes) -> list[int]:
    return list(struct.unpack(f"<{len(raw) // 4}I", raw))


def _over(docs: DataFrame, id_col: str, text_col: str, path: str | None, schema: str, row) -> DataFrame:
    with open(path or tokenizer_path(), "rb") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: a few MB

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = from_text(held.value)
        for pdf in batches:
            for at in range(0, len(pdf), 256):  # results of few texts at a time
                part = pdf.iloc[at : at + 256]
                out = pd.DataFrame([row(bpe, t or "") for t in part.iloc[:, 1]], columns=[c.split()[0] for c in schema.split(", ")][1:])
                out.insert(0, "doc_id", part.iloc[:, 0].astype("Int64").to_numpy(dtype=object, na_value=None))
                yield out
        bpe.cache.clear()  # the vocabulary and the pairs stay for the worker's next task
        trim()

    return docs.select(docs[id_col].cast("long"), docs[text_col]).mapInPandas(run, schema)


def _full(bpe: Bpe, text: str) -> tuple:
    ids = bpe.encode(text)
    return len(ids), pack(ids), bpe.decode(ids)


def _digest(bpe: Bpe, text: str) -> tuple:
    ids = bpe.encode(text)
    return len(ids), hashlib.sha256(pack(ids)).hexdigest(), hashlib.sha256(bpe.decode(ids).encode("utf-8")).hexdigest()


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and the text decoded from those ids.

    Null or empty text: no ids, empty decoded text. Row by row: null ids and repeated rows stay,
    other columns are ignored, an empty table gives an empty table.
    """
    return _over(docs, id_col, text_col, path, SCHEMA, _full)


def encode_digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As encode(), with SHA-256 digests in the place of ids and decoded text, taken where they are
    made so that neither leaves the worker."""
    return _over(docs, id_col, text_col, path, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", _digest)
