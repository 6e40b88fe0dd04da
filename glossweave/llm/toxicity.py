"""Toxic passages by maximum-scoring segments.

Every word carries a log-odds score, toxic against clean documents, under a chain of Dirichlet priors:
the toxic share of a word's documents has its longest prefix's share as prior, and so on down to the
share of all labelled documents, so that unseen inflections and compounds of telling stems count.
Scores under LEAST are zero, and a drift a word makes clean text lose. One linear scan finds all
maximal-scoring segments of a text. Their scores follow an extreme-value law in clean text, whose rate
comes from the word scores of clean documents and whose scale from their largest segments; a
document's score joins its significant segments and is calibrated on labelled documents that the word
scores did not see. The model that scores has these documents counted in as well.

At most MAX_LABELLED labelled documents, drawn by a hash of their id and without copies of each other,
fit the model; only their labels are broadcast, and counts are kept in a table of BUCKETS. All
documents are scored by one narrow map over the scan.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import chain
from math import log
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, materialize, trim

BUCKETS = 1 << 18
HALF = BUCKETS // 2
MAX_LABELLED = 20_000
#: Weight of a prior in documents; least log-odds that counts; largest score; drift a word.
STRENGTH, LEAST, MOST, DRIFT = 8.0, 2.2, 6.0, 0.5
CALIBRATION_FOLD = 4
PREFIXES = (6, 5, 4, 3)
WORDS = re.compile(r"[^\W_]+")
CACHE_WORDS = 150_000


def places(unit: str) -> tuple[int, int]:
    """A unit's bucket in either half of the table."""
    raw = unit.encode("utf-8", "replace")
    return crc32(raw) % HALF, HALF + crc32(raw, 0x9747B28C) * 2654435761 % 4294967291 % HALF


class Buckets(dict):
    """Word to the buckets of the word and its prefixes, for some words (an entry is some 500 bytes)."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= CACHE_WORDS // 8:
            self.clear()
        units = [word, *(word[:k] + "-" for k in PREFIXES if len(word) > k)]
        found = self[word] = tuple(b for u in units for b in places(u))
        return found


_BUCKETS = Buckets()


class Scores(dict):
    """Word to score. A unit's counts are the smaller of its two buckets'."""

    def __init__(self, model: Model):
        super().__init__()
        self.toxic, self.clean, self.base = model.toxic.tolist(), model.clean.tolist(), model.base
        self.logit = log(self.base / (1 - self.base))
        self.prefixes: dict[str, float] = {}

    def share(self, unit: str, prior: float) -> float:
        a, b = places(unit)
        t, c = min(self.toxic[a], self.toxic[b]), min(self.clean[a], self.clean[b])
        return (t + STRENGTH * prior) / (t + c + STRENGTH)

    def of_prefix(self, prefix: str) -> float:
        found = self.prefixes.get(prefix)
        if found is None:
            if len(self.prefixes) >= CACHE_WORDS:
                self.prefixes.clear()
            shorter = self.of_prefix(prefix[:-1]) if len(prefix) > PREFIXES[-1] else self.base
            found = self.prefixes[prefix] = self.share(prefix + "-", shorter)
        return found

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHE_WORDS:
            self.clear()
        n = min(len(word) - 1, PREFIXES[0])
        share = self.share(word, self.of_prefix(word[:n]) if n >= PREFIXES[-1] else self.base)
        v = log(max(share, 1e-4) / max(1 - share, 1e-4)) - self.logit
        found = self[word] = (min(v, MOST) if v > LEAST else -DRIFT / 2 if v < -LEAST else 0.0) - DRIFT
        return found


def words_of(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


def units_of(text: str | None) -> np.ndarray:
    """The distinct buckets of a text's words and their prefixes."""
    return np.fromiter(set(chain.from_iterable(map(_BUCKETS.__getitem__, set(words_of(text))))), np.int64)


@dataclass
class Model:
    toxic: np.ndarray  # documents by bucket
    clean: np.ndarray
    base: float  # share of toxic documents
    rate: float  # of the extreme-value law
    log_k: float
    weights: tuple[float, float, float]  # of 1, the largest normalised score, log(1 + the joined one)

    def by_word(self) -> Scores:
        return Scores(self)

    def probability(self, x: np.ndarray, joined: np.ndarray) -> np.ndarray:
        w = self.weights
        z = w[0] + w[1] * np.clip(x, -20, 40) / 10 + w[2] * np.log1p(np.clip(joined, 0, 1e6))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def extreme_rate(values: np.ndarray, counts: np.ndarray) -> float:
    """The positive root of sum p(s) exp(rate s) = 1 over the word scores of clean documents, with one
    more word of the largest score so that there is a root."""
    s, n = np.append(values, MOST), np.append(counts, 1.0)
    p = n / n.sum()
    if (p * s).sum() >= 0:
        return 1.0
    low, high = 1e-4, 50.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(np.minimum(mid * s, 700))).sum() < 1 else (low, mid)
    return (low + high) / 2


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments as (start, end, score), end exclusive, in order.

    Linear: every positive token opens a candidate; a candidate is joined with the nearest earlier one
    that began lower, as long as the joined one ends higher than that one did.
    """
    cum = np.concatenate(([0.0], np.cumsum(scores, dtype=np.float64)))
    at = np.flatnonzero(scores > 0)
    stack: list[tuple[int, int, float, float]] = []  # start, end, level before, level after
    lower: list[int] = []  # index of the nearest earlier candidate whose level before is lower, or -1
    for i in at.tolist():
        start, end, left, right = i, i + 1, float(cum[i]), float(cum[i + 1])
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j = lower[j]
            if j < 0 or stack[j][3] >= right:
                stack.append((start, end, left, right))
                lower.append(j)
                break
            start, left = stack[j][0], stack[j][2]
            del stack[j:], lower[j:]
    return [(s, e, r - lv) for s, e, lv, r in stack]


def features(model: Model, by_word: Scores, text: str | None) -> tuple[float, float, int, list[tuple[int, int, float]]]:
    """Largest normalised segment score, sum of the significant ones, words, significant segments."""
    t = words_of(text)
    found = segments(np.fromiter(map(by_word.__getitem__, t), np.float64, len(t)))
    base = model.log_k + np.log(max(len(t), 1))
    normal = [(s, e, model.rate * v - base) for s, e, v in found]
    significant = [x for x in normal if x[2] > 0]
    return max((x[2] for x in normal), default=-base), sum(x[2] for x in significant), len(t), significant


def labelled(labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id and label of at most max_labelled ids outside fold 0; conflicting labels count as toxic."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold(F.col("doc_id")) != 0))
    known = known.groupBy(F.col("doc_id").cast("long").alias("__d")).agg((F.max("toxic") > 0).cast("int").alias("__y"))
    return known.orderBy(F.xxhash64("__d"), "__d").limit(max_labelled)


def minima(text: str | None) -> list[int]:
    """Four min-hashes of a text's set of five-word shingles (of all its words, if there are fewer)."""
    words = words_of(text)
    h = np.fromiter((crc32(w.encode("utf-8", "replace")) for w in words), np.uint64, len(words))
    n = max(1, len(h) - 4)
    mixed = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(5, len(h))):
            mixed = (mixed ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(31)
        return [int(((mixed * np.uint64(0xD6E8FEB86659FD93 + 2 * k)) >> np.uint64(2)).min()) for k in range(4)]


def one_of_copies(docs: DataFrame, known: DataFrame) -> DataFrame:
    """known (bounded) without the labelled documents that share a min-hash, in four rounds, with one
    of a smaller id: copies are not independent evidence."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pd.DataFrame([minima(t) for t in pdf["text"]], columns=["m1", "m2", "m3", "m4"])
            yield out.assign(__d=pdf["__d"].to_numpy(), __y=pdf["__y"].to_numpy())

    marked = docs.join(F.broadcast(known), docs["doc_id"] == known["__d"]).select("text", "__d", "__y")
    left = marked.mapInPandas(run, "m1 long, m2 long, m3 long, m4 long, __d long, __y int")
    for k in ("m1", "m2", "m3", "m4"):
        left = left.groupBy(k).agg(F.min(F.struct("__d", "__y", *(x for x in ("m1", "m2", "m3", "m4") if x != k))).alias("s")).select(k, "s.*")
    return left.select("__d", "__y").groupBy("__d").agg(F.max("__y").alias("__y"))


def _counts(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Documents by bucket and their numbers, each by group: clean, toxic, and clean, toxic of the calibration
    fold. docs: text, group."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, n = np.zeros((4, BUCKETS), np.int32), [0] * 4
        for pdf in batches:
            for text, g in zip(pdf["text"], pdf["group"], strict=True):
                c[g, units_of(text)] += 1
                n[g] += 1
        if sum(n):
            at = np.flatnonzero(c.any(0))
            yield pd.DataFrame({"b": np.append(at, -1), **{f"c{g}": np.append(c[g, at], n[g]).astype(np.int64) for g in range(4)}})
        _BUCKETS.clear()
        trim()

    names = [f"c{g}" for g in range(4)]
    rows = docs.mapInPandas(run, "b int, " + ", ".join(f"{x} long" for x in names)).groupBy("b").agg(*(F.sum(x).alias(x) for x in names))
    out = np.zeros((4, BUCKETS + 1), np.int64)  # bucket -1 holds the numbers
    pdf = rows.toPandas()  # at most BUCKETS + 1 rows
    for g, x in enumerate(names):
        out[g, pdf["b"].to_numpy(np.int64)] = pdf[x].to_numpy(np.int64)
    return out[:, :-1], out[:, -1]


def _clean_rate(docs: DataFrame, model: Model) -> float:
    """The extreme-value rate from the word scores of clean documents, binned by quarters."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_word, bins = held.value.by_word(), np.zeros(64, np.int64)
        for pdf in batches:
            for text in pdf["text"]:
                t = words_of(text)
                bins += np.bincount(np.clip(np.round(4 * np.fromiter(map(by_word.__getitem__, t), float, len(t))) + 8, 0, 63).astype(np.int64), minlength=64)
        at = np.flatnonzero(bins)
        yield pd.DataFrame({"b": at, "n": bins[at]})

    pdf = docs.mapInPandas(run, "b int, n long").groupBy("b").agg(F.sum("n").alias("n")).toPandas()  # at most 64 rows
    return extreme_rate((pdf["b"].to_numpy(float) - 8) / 4, pdf["n"].to_numpy(float)) if len(pdf) else 1.0


def _scored(docs: DataFrame, model: Model, extra: str) -> DataFrame:
    """docs: doc_id, text and a pass-through column named extra; gives x, joined, words, passages."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # 4 bytes a bucket
    kind = dict(docs.dtypes)[extra]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = held.value
        by_word = m.by_word()
        for pdf in batches:
            rows = [features(m, by_word, t) for t in pdf["text"]]
            x, joined = np.array([r[0] for r in rows], float), np.array([r[1] for r in rows], float)
            out = pd.DataFrame({"x": x, "joined": joined, "words": [r[2] for r in rows], "score": m.probability(x, joined)})
            out["passages"] = [[{"start": s, "end": e, "score": v} for s, e, v in r[3]] for r in rows]
            out["doc_id"] = pdf["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None)
            out[extra] = pdf[extra]
            yield out
        by_word.clear()
        trim()

    return docs.mapInPandas(run, f"x double, joined double, words long, score double, passages array<struct<start:int,end:int,score:double>>, doc_id long, {extra} {kind}")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> Model:
    """Token scores from the labelled documents of folds 1 to 3; rate, scale and calibration from fold 4; then
    the counts of fold 4 join those of the others.

    With no toxic or no clean label in folds 1 to 3 the model scores everything 0.
    """
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    known = materialize(one_of_copies(own, labelled(labels, max_labelled)), "toxic-labels")
    of = lambda k: own.join(F.broadcast(k), own["doc_id"] == k["__d"])  # noqa: E731  at most max_labelled rows
    later = F.col("__d").isNotNull() & (fold(F.col("__d")) == CALIBRATION_FOLD)
    c, n = _counts(of(known).select("text", (F.col("__y") + 2 * later.cast("int")).alias("group")))
    if not n[0] or not n[1]:
        return Model(c[1], c[0], 0.5, 1.0, 0.0, (-30.0, 0.0, 0.0))
    model = Model(c[1], c[0], n[1] / (n[0] + n[1]), 1.0, 0.0, (0.0, 0.0, 0.0))
    held_back = known.where(later)
    model.rate = _clean_rate(of(held_back.where("__y = 0")).select("text"), model)
    seen = _scored(of(held_back).select("doc_id", "text", F.col("__y").alias("y")), model, "y")
    # the normalised score at log_k = 0, in bins: a bounded table however many rows share an id
    binned = seen.select("y", F.round(F.least(F.greatest("x", F.lit(-30.0)), F.lit(60.0)) * 4).alias("x"), F.round(F.log1p("joined") * 10).alias("j"))
    pdf = binned.groupBy("y", "x", "j").count().toPandas()
    if not len(pdf) or pdf["y"].nunique() < 2:
        model = replace(model, weights=(-1.0, 1.0, 1.0))
    else:
        y, m, x, j = pdf["y"].to_numpy(float), pdf["count"].to_numpy(float), pdf["x"].to_numpy(float) / 4, np.expm1(pdf["j"].to_numpy(float) / 10)
        model = calibrate(model, x, j, y, m)
    return replace(model, toxic=c[1] + c[3], clean=c[0] + c[2])


def calibrate(model: Model, x: np.ndarray, joined: np.ndarray, y: np.ndarray, n: np.ndarray) -> Model:
    """The scale from the mean clean maximum (an extreme-value variable has mean log k + 0.5772), then
    a logistic fit, by Newton steps with a small ridge."""
    clean = (y == 0) & (x > -15)
    log_k = float(np.average(x[clean], weights=n[clean]) - 0.5772) if clean.any() else 0.0
    # normalising by log_k shifts every segment; the joined sum keeps its first-order form
    design = np.column_stack([np.ones_like(x), np.clip(x - log_k, -20, 40) / 10, np.log1p(np.clip(joined, 0, 1e6))])
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (n * (y - p)) - 1e-2 * w
        step = np.linalg.solve((design * (n * p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(3), gradient)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return replace(model, log_k=log_k, weights=(float(w[0]), float(w[1]), float(w[2])))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row a row of docs: doc_id, held_out, score, predicted, and the significant passages as word
    ranges. Null or empty text is a text without words. Null ids (held out), repeated rows and ties
    pass row by row; other columns are ignored; an empty table gives an empty table."""
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), (fold(docs[id_col]) == 0).alias("held_out"))
    out = _scored(own, model, "held_out")
    return out.select("doc_id", "held_out", "score", (out["score"] >= threshold).cast("int").alias("predicted"), "passages")


def accept(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs' rows, all columns, whose score is below the threshold. Only text goes to Python."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = held.value
        by_word = m.by_word()
        for texts in batches:
            rows = [features(m, by_word, t)[:2] for t in texts]
            yield pd.Series(m.probability(np.array([r[0] for r in rows], float), np.array([r[1] for r in rows], float)))
        by_word.clear()
        trim()

    return docs.where(F.pandas_udf(run, "double")(docs[text_col]) < threshold)
