"""Token counts of whole texts by a public sentencepiece vocabulary, huge texts by overlapping chunks.

Texts up to LONG characters are encoded whole, in one narrow map. Longer ones are cut into chunks, each of which
begins an overlap before the end of the one before it, and the chunks of a text are encoded by whatever tasks
there are. A chunk's tokens near its beginning may be wrong, as the encoder puts a space before it and doesn't
see what came earlier. Each chunk therefore gives the token borders in its overlaps, with the tokens before
each, and keeps those that are proven stable: no piece of the vocabulary holds the two characters beside the
border next to each other, so no merge ever crosses it and what stands on either side is encoded on its own.
Neighbours are spliced at the last stable border that both found, and the counts between the splices add up.
Where two neighbours share none, the text is encoded again in chunks and overlaps WIDEN times as long, until
all of its neighbours meet or one chunk holds it. Counts depend on a text alone, so copies go by its digest.

Only chunks of long texts, their borders and sums are shuffled. A task holds an Arrow batch and a chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions, trim

LONG, CHUNK, OVERLAP, WIDEN = 1 << 15, 1 << 15, 128, 4
#: Fixed values of the format: a space is this character inside a vocabulary; pieces of kind 1 are plain text, 6 single bytes.
BLANK, PLAIN, BYTE = "▁", 1, 6
LIMIT = 4096

_LOADED: dict[int, Pieces] = {}


class Pieces:
    """A sentencepiece BPE vocabulary with what proves borders stable."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(model)
        rules, kinds = spec.normalizer_spec, {p.type for p in spec.pieces} - {PLAIN, BYTE}
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces or not rules.add_dummy_prefix or spec.trainer_spec.model_type != 2 or not spec.trainer_spec.byte_fallback or kinds - {2, 3}:
            raise ValueError("only BPE vocabularies that leave texts as they are, with byte fallback, are read")
        self.own = SentencePieceProcessor(model_proto=model)
        # characters that a token adds to the text: a byte counts if it is the first of its character
        self.chars = np.array([len(p.piece) if p.type == PLAIN else 1 if p.type == BYTE and int(p.piece[3:5], 16) & 0xC0 != 0x80 else 0 for p in spec.pieces])
        self.joined = np.unique([_pair(ord(a), ord(b)) for p in spec.pieces if p.type == PLAIN for a, b in zip(p.piece, p.piece[1:], strict=False)])

    def counts(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.own.encode(texts, num_threads=1)]

    def stable(self, text: str, low: int, high: int) -> np.ndarray:
        """The places p in [low, high] inside text where no piece joins the characters at p - 1 and p."""
        low, high = max(low, 1), min(high, len(text) - 1)
        codes = np.frombuffer(text[low - 1 : high + 1].replace(" ", BLANK).encode("utf-32-le"), "<u4").astype(np.int64)
        return low + np.flatnonzero(~np.isin(_pair(codes[:-1], codes[1:]), self.joined))

    def borders(self, text: str, zones: list[tuple[int, int]]) -> tuple[int, list[tuple[np.ndarray, np.ndarray]]]:
        """The number of tokens, and for each zone its stable borders and the tokens before each of them."""
        ids = np.asarray(self.own.encode(text), np.int64)
        ends = np.cumsum(self.chars[ids]) - 1  # the first character is the space that the encoder puts in front
        found = []
        for low, high in zones:
            at = self.stable(text, low, high)
            before = np.searchsorted(ends, at, "right")
            held = (before > 0) & (ends[np.maximum(before - 1, 0)] == at) if len(ends) else np.zeros(len(at), bool)
            found.append((at[held], before[held]))
        return len(ids), found


def _pair(a, b):
    return a << 32 | b


def loaded(model: bytes) -> Pieces:
    """One vocabulary per Python worker and file."""
    key = hash(model)
    if key not in _LOADED:
        _LOADED[key] = Pieces(model)
    return _LOADED[key]


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _short(docs: DataFrame, held) -> DataFrame:
    """doc_id, text: doc_id, n_bytes, n_tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = loaded(held.value)
        for pdf in batches:
            for at in range(0, len(pdf), 256):  # ids of few texts at a time
                part = pdf.iloc[at : at + 256]
                yield pd.DataFrame({"doc_id": part["doc_id"], "n_bytes": part["n_bytes"], "n_tokens": pieces.counts(list(part["text"]))})
        trim()

    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    return own.mapInPandas(run, "doc_id long, n_bytes long, n_tokens long")


def _chunks(texts: DataFrame, size: int, overlap: int) -> DataFrame:
    """texts: digest, text. digest, ix, start, last, text: chunk ix ends size characters after the one before it
    and starts an overlap before that one's end."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for digest, text in zip(pdf["digest"], pdf["text"], strict=True):
                n = max(1, -(-len(text) // size))
                for i in range(n):
                    start = max(0, i * size - overlap)
                    yield pd.DataFrame({"digest": [digest], "ix": [i], "start": [start], "last": [i == n - 1], "text": [text[start : (i + 1) * size]]})

    return texts.mapInPandas(run, "digest binary, ix long, start long, last boolean, text string")


def _encoded(chunks: DataFrame, held, size: int, overlap: int) -> DataFrame:
    """Rows of zones, where a chunk meets the next: digest, zone, tail (borders of the chunk before it), head (of
    the one after it), each an array of (at, n); n: the tokens of the chunk after it, if that is the last."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = loaded(held.value)
        for pdf in batches:
            rows = []
            for c in pdf.itertuples(index=False):
                cut, end = c.ix * size - c.start, (c.ix + 1) * size - c.start
                n, (head, tail) = pieces.borders(c.text, [(cut - overlap, cut), (end - overlap, end)])
                shown = lambda zone, start=c.start: [{"at": int(p + start), "n": int(k)} for p, k in zip(*zone, strict=True)]
                rows.append((c.digest, c.ix, None, shown(head), n if c.last else None))
                if not c.last:
                    rows.append((c.digest, c.ix + 1, shown(tail), None, None))
            yield pd.DataFrame(rows, columns=["digest", "zone", "tail", "head", "n"]).astype({"n": "Int64"})
        trim()

    return chunks.mapInPandas(run, "digest binary, zone long, tail array<struct<at:long,n:long>>, head array<struct<at:long,n:long>>, n long")


def _spliced(zones: DataFrame) -> DataFrame:
    """digest, n_tokens (null where two neighbours share no stable border)."""
    met = zones.groupBy("digest", "zone").agg(*(F.max(c).alias(c) for c in ("tail", "head", "n")))  # copies give the same rows
    places = lambda c: F.transform(c, lambda b: b["at"])
    at = F.array_max(F.array_intersect(places("tail"), places("head")))
    before = lambda c: F.get(F.filter(c, lambda b: b["at"] == F.col("at")), F.lit(0))["n"]
    met = met.withColumn("at", at).withColumn("apart", (F.col("zone") > 0) & F.col("at").isNull())
    own = F.when(F.col("zone") > 0, before("tail") - before("head")).otherwise(0) + F.coalesce("n", F.lit(0))
    whole = met.groupBy("digest").agg(F.sum(own).alias("n_tokens"), F.max("apart").alias("apart"))
    return whole.select("digest", F.when(~F.col("apart"), F.col("n_tokens")).alias("n_tokens"))


def long_counts(texts: DataFrame, held, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """texts: digest, text. digest, n_tokens, a row a digest; written."""
    spark, done, left = texts.sparkSession, None, None
    while True:
        asked = texts if left is None else texts.join(left.hint("merge"), "digest", "left_semi")
        dealt = _chunks(asked, size, overlap).repartition(shuffle_partitions(spark), "digest", "ix")
        found = materialize(_spliced(_encoded(dealt, held, size, overlap)), "token-counts")
        done = found if done is None else done.unionByName(found)
        left = found.where("n_tokens is null").select("digest")
        if left.isEmpty():
            return done.where("n_tokens is not null")
        size, overlap = size * WIDEN, overlap * WIDEN


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", long: int = LONG, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row a row of docs: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    path: a sentencepiece model file; the library's defaults hold, without begin, end or added special tokens.
    long: characters that are encoded in one piece; beyond them, texts go by chunk and overlap (shorter than chunk).
    Null and empty texts have no bytes and no tokens. Null ids and repeated rows stay, each with its counts; ties
    do not occur. Other columns are ignored, an empty table gives an empty table.
    """
    with open(path or tokenizer_path(), "rb") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: half a MB
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    is_long = F.coalesce(F.length("text") > long, F.lit(False))
    digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")
    counts = long_counts(own.where(is_long).select(digest, "text"), held, chunk, overlap)
    named = own.where(is_long).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), digest)
    by_chunks = named.join(counts.hint("merge"), "digest").select("doc_id", "n_bytes", "n_tokens")
    return _short(own.where(~is_long), held).unionByName(by_chunks).withColumn("over_limit", F.col("n_tokens") > limit)
