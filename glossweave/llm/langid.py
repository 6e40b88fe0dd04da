"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its hashed character n-grams (2 to 4 code points inside
words, word ends marked); a linear softmax over that mean gives the languages. Embeddings and softmax
are trained together by mini-batch stochastic gradient descent in numpy on the driver, from at most
MAX_ROWS labelled documents and one random piece of each. A part held back from training fits a
temperature and the score below which a prediction is rejected (column accepted).

The sample is drawn by a hash of the ids (two narrow passes and a bounded top-k); each sampled document
reaches the driver as a vector of BUCKETS numbers, however long it is. All documents are then scored
by one narrow map over the scan.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold

BUCKETS, DIM, ORDERS = 4096, 16, (2, 3, 4)
MAX_ROWS = 2000
EPOCHS, BATCH, RATE = 60, 64, 0.5
HELD_BACK, ACCEPT_ACCURACY = 0.2, 0.99
PIECE = 20_000  # code points hashed at a time
_LETTER: list[np.ndarray] = []


def is_letter() -> np.ndarray:
    """By code point, as str.isalpha."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def counts(text: str | None) -> np.ndarray:
    """How often each bucket's n-grams occur in the whole text."""
    out = np.zeros(BUCKETS, np.float32)
    text = (text or "").lower()
    letters = is_letter()
    for at in range(0, len(text), PIECE):  # pieces overlap by the longest order less one
        part = text[max(0, at - ORDERS[-1] + 1) : at + PIECE]
        cp = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        word = letters[cp]
        cp = np.where(word, cp, np.uint32(32))
        if at + PIECE >= len(text):  # the end of the text ends a word
            cp, word = np.append(cp, np.uint32(32)), np.append(word, False)
        if at == 0:
            cp, word = np.insert(cp, 0, np.uint32(32)), np.insert(word, 0, False)
        first = 0 if at == 0 else ORDERS[-1] - 1
        for n in ORDERS:
            size = len(cp) - n + 1
            if size <= 0:
                continue
            h = np.full(size, n, np.uint32)
            ok = word[:size] | word[n - 1 :]
            for k in range(n):
                h = (h ^ cp[k : k + size]) * np.uint32(0x9E3779B1)
                h ^= h >> np.uint32(15)
                if 0 < k < n - 1:
                    ok = ok & word[k : k + size]
            skip = max(0, first - n + 1)  # n-grams that end in the piece before are counted there
            out += np.bincount((h[skip:] & np.uint32(BUCKETS - 1))[ok[skip:]], minlength=BUCKETS)
    return out


def vector(text: str | None) -> np.ndarray:
    c = counts(text)
    total = c.sum()
    return c / total if total else c


def piece_of(text: str) -> str:
    """Twenty to two hundred code points from a place that the text's own hash gives."""
    h = zlib.crc32(text.encode("utf-8", "replace"))
    size = 20 + h % 180
    at = (h >> 8) % max(1, len(text) - size)
    return text[at : at + size]


@dataclass
class Model:
    langs: list[str] = field(default_factory=list)
    embeddings: np.ndarray | None = None
    weights: np.ndarray | None = None
    bias: np.ndarray | None = None
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.embeddings) @ self.weights + self.bias

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return softmax(self.logits(x) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(x: np.ndarray, labels: list[str], groups: np.ndarray, seed: int = 7) -> Model:
    """x: one vector a row (zero rows are left out); groups: rows of one group are held back together."""
    langs = sorted(set(labels))
    some = x.any(1)
    if not some.any():
        return Model()
    y = np.array([langs.index(v) for v in labels])
    back = np.array([zlib.crc32(str(g).encode()) % 1000 < 1000 * HELD_BACK for g in groups])
    if back.all() or not back.any():
        back = np.zeros(len(y), bool)
    learn = np.flatnonzero(~back & some)
    rng = np.random.default_rng(seed)
    scale = np.float32(np.sqrt(BUCKETS))  # vectors sum to 1; this brings them to a unit size
    model = Model(langs, rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32), np.zeros((DIM, len(langs)), np.float32), np.zeros(len(langs), np.float32))
    model.weights = rng.normal(0, 0.1, model.weights.shape).astype(np.float32)
    one = np.eye(len(langs), dtype=np.float32)[y]
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for at in np.array_split(rng.permutation(learn), max(1, len(learn) // BATCH)):
            v = x[at] * scale
            h = v @ model.embeddings
            g = (softmax(h @ model.weights + model.bias) - one[at]) / len(at)
            dh = g @ model.weights.T
            model.weights -= rate * (h.T @ g)
            model.bias -= rate * g.sum(0)
            model.embeddings -= rate * (v.T @ dh)
    model.embeddings *= scale
    back &= some
    if back.any():
        z, yb = model.logits(x[back]), y[back]
        loss = {t: -np.log(softmax(z / t)[np.arange(len(yb)), yb] + 1e-9).mean() for t in np.geomspace(0.25, 8, 41)}
        model.temperature = float(min(loss, key=loss.get))
        p = model.probabilities(x[back])
        best, right = p.max(1), p.argmax(1) == yb
        order = np.argsort(-best, kind="stable")
        good = np.flatnonzero(np.cumsum(right[order]) >= ACCEPT_ACCURACY * np.arange(1, len(yb) + 1))
        model.threshold = float(best[order][good[-1]]) if len(good) else 1.0
    return model


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = MAX_ROWS) -> Model:
    """Learns from text and lang of documents outside fold 0; an id counts once, by its smallest text."""
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), docs[lang_col].alias("lang"))
    own = own.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
    ids = own.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).withColumnRenamed("doc_id", "__d")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[[has_letter(t) for t in pdf["text"]]]
            rows = [(d, lang, zlib.crc32(t.encode("utf-8", "replace")), vector(t).astype(np.float16).tobytes(), vector(piece_of(t)).astype(np.float16).tobytes()) for d, t, lang in zip(pdf["doc_id"], pdf["text"], pdf["lang"], strict=True)]
            yield pd.DataFrame(rows, columns=["doc_id", "lang", "h", "v", "p"])

    sample = own.join(F.broadcast(ids), own["doc_id"] == F.col("__d")).select("doc_id", "text", "lang")  # at most max_rows ids
    rows = sample.mapInPandas(run, "doc_id long, lang string, h long, v binary, p binary").groupBy("doc_id").agg(F.min(F.struct("h", "lang", "v", "p")).alias("r"))
    pdf = rows.select("doc_id", "r.*").toPandas().sort_values("doc_id")  # at most max_rows vectors
    if not len(pdf):
        return Model()
    x = np.zeros((2 * len(pdf), BUCKETS), np.float32)
    for i, v in enumerate([*pdf["v"], *pdf["p"]]):
        x[i] = np.frombuffer(v, np.float16)
    langs, ids_ = list(pdf["lang"]) * 2, np.concatenate([pdf["doc_id"]] * 2)
    del pdf
    return train(x, langs, ids_)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of docs: doc_id, held_out, lang_pred, score, accepted.

    Null, empty or letterless text, and any text while the model has learned no language: und, 0.0, not
    accepted. Null ids are held out; repeated rows and ties pass row by row (a tie of two languages goes
    to the first by code point); other columns are ignored; an empty table gives an empty table.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x DIM numbers

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = held.value
        for pdf in batches:
            n = len(pdf)
            lang, score = np.full(n, "und", object), np.zeros(n)
            known = np.flatnonzero([has_letter(t) for t in pdf["text"]]) if m.langs else np.zeros(0, np.int64)
            for at in range(0, len(known), 256):
                some = known[at : at + 256]
                p = m.probabilities(np.array([vector(pdf["text"].iat[i]) for i in some], np.float32))
                lang[some], score[some] = np.array(m.langs, object)[p.argmax(1)], p.max(1)
            out = pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None), "held_out": pdf["held_out"]})
            yield out.assign(lang_pred=lang, score=score, accepted=(lang != "und") & (score >= m.threshold))

    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), (fold(docs[id_col]) == 0).alias("held_out"))
    return own.mapInPandas(run, "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean")
