"""Reversible line deduplication.

State, all in tables (save() and load() keep them between sessions):
  postings  key, doc_id, text_hash: which document holds which long line (one row a document)
  refs      key, n_docs, last_doc: the exact reference counts, derived from postings
  filters   shard, table: a cuckoo filter for each shard of the keys found in min_docs documents
Documents are inserted and deleted by changing postings; the counts of the keys they touch are
recomputed, and keys that cross min_docs are inserted into or deleted from the filter of their
shard. A filter that would be filled beyond LOAD is built anew from the exact counts, and all are when
shards hold more than SHARD_KEYS keys on average.

When documents are cleaned, postings meet the filter and the exact counts of their shard: one shuffle by
shard, in which the filter comes first, then the shard's counted keys, then its postings in batches. The
filter has no false negatives, so what it does not hold is settled; the rest is decided by the counts. A
shard with many postings (a line of a third of all documents lies in one) is dealt out over several tasks,
each with a copy of filter and counts, which SHARD_KEYS bounds. Keys are 128-bit BLAKE2b digests of the
normalised line.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, materialize, trim, unused

MIN_CHARS = 40
MIN_DOCS = 5
SHARD_KEYS = 500_000
TASK_POSTINGS = 250_000  # of one shard that one task looks up, about
LOAD = 0.9  # share of a filter's places that may be taken


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; insert, delete and contain 16-byte keys.

    Keys that find no place after MAX_KICKS moves go to a small exact stash, so there are no false
    negatives. Inserting a key n times needs n deletions.
    """

    SLOTS, MAX_KICKS = 4, 200

    def __init__(self, n_keys: int = 0, raw: bytes | None = None):
        if raw is None:
            bits = max(2, int(np.ceil(np.log2(max(1, n_keys) / (self.SLOTS * 0.85) + 1))))
            self.table, self.stash = np.zeros((1 << bits, self.SLOTS), np.uint16), Counter()
        else:
            n, m = np.frombuffer(raw[:16], np.int64)
            self.table = np.frombuffer(raw[16 : 16 + n * self.SLOTS * 2], np.uint16).reshape(n, self.SLOTS).copy()
            self.stash = Counter(raw[len(raw) - 16 * (m - i) :][:16] for i in range(m))
        self.mask = len(self.table) - 1

    def to_bytes(self) -> bytes:
        stash = list(self.stash.elements())
        return np.array([len(self.table), len(stash)], np.int64).tobytes() + self.table.tobytes() + b"".join(stash)

    def has_room(self, more: int) -> bool:
        """Whether so many more keys leave the table filled to LOAD at most."""
        return np.count_nonzero(self.table) + self.stash.total() + more <= LOAD * self.table.size

    def places(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First bucket, second bucket and fingerprint (never 0) of each key."""
        parts = np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)
        prints = (parts[:, 1] >> np.uint64(48)).astype(np.uint16)
        prints[prints == 0] = 1
        first = (parts[:, 0] & np.uint64(self.mask)).astype(np.int64)
        return first, self.other(first, prints), prints

    def other(self, bucket, print_):
        return (bucket ^ (np.asarray(print_).astype(np.int64) * 0x5BD1E995)) & self.mask

    def insert(self, keys: list[bytes]) -> None:
        if not keys:
            return
        for key, a, b, p in zip(keys, *(x.tolist() for x in self.places(keys)), strict=True):
            if not self._put(a, p) and not self._put(b, p) and not self._kick(b, p):
                self.stash[key] += 1

    def _put(self, bucket: int, print_: int) -> bool:
        row = self.table[bucket]
        for s in range(self.SLOTS):
            if not row[s]:
                row[s] = print_
                return True
        return False

    def _kick(self, bucket: int, print_: int) -> bool:
        moved = []
        for k in range(self.MAX_KICKS):
            s = (k + print_) % self.SLOTS
            old = int(self.table[bucket][s])
            self.table[bucket][s] = print_
            moved.append((bucket, s, old))
            bucket, print_ = int(self.other(bucket, old)), old
            if self._put(bucket, print_):
                return True
        for bucket, s, old in reversed(moved):  # as it was; the caller keeps the key in the stash
            self.table[bucket][s] = old
        return False

    def delete(self, keys: list[bytes]) -> None:
        if not keys:
            return
        for key, a, b, p in zip(keys, *(x.tolist() for x in self.places(keys)), strict=True):
            if key in self.stash:
                self.stash[key] -= 1
                if not self.stash[key]:
                    del self.stash[key]
                continue
            for bucket in (a, b):
                at = np.flatnonzero(self.table[bucket] == p)
                if len(at):
                    self.table[bucket][at[0]] = 0
                    break

    def contains(self, keys: list[bytes]) -> np.ndarray:
        if not keys:
            return np.zeros(0, bool)
        a, b, p = self.places(keys)
        found = (self.table[a] == p[:, None]).any(1) | (self.table[b] == p[:, None]).any(1)
        if self.stash:
            found |= np.fromiter((k in self.stash for k in keys), bool, len(keys))
        return found


def line_key(line: str, min_chars: int = MIN_CHARS) -> bytes | None:
    """The digest of the line stripped of [\\x20\\x09-\\x0D] with A-Z lower-cased; None if too short."""
    line = line.strip(SPACE)
    return hashlib.blake2b(line.encode("utf-8", "replace").lower(), digest_size=16).digest() if len(line) >= min_chars else None


def text_hash(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest()


def shard_of(key, n_shards: int):
    return F.pmod(F.xxhash64(key), F.lit(n_shards)).cast("int")


@dataclass
class LineIndex:
    """The three tables, each a materialised DataFrame."""

    postings: DataFrame
    refs: DataFrame
    filters: DataFrame
    n_shards: int
    min_chars: int = MIN_CHARS
    min_docs: int = MIN_DOCS


def postings_of(docs: DataFrame, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, hashes, keys = [], [], []
            for doc_id, text in zip(pdf.iloc[:, 0].astype("Int64").to_numpy(dtype=object, na_value=None), pdf.iloc[:, 1], strict=True):
                if text and len(text) >= min_chars:
                    own = {k for line in text.split("\n") if len(line) >= min_chars and (k := line_key(line, min_chars))}
                    if own:
                        ids += [doc_id] * len(own)
                        hashes += [text_hash(text)] * len(own)
                        keys += own
            yield pd.DataFrame({"key": keys, "doc_id": pd.Series(ids, dtype=object), "text_hash": hashes})
        trim()

    return docs.select(docs[id_col].cast("long"), docs[text_col]).mapInPandas(run, "key binary, doc_id long, text_hash binary")


def count_refs(postings: DataFrame) -> DataFrame:
    """Exact counts. Two partial aggregates, so a line of a third of all documents is summed map-side."""
    return postings.select("key", "doc_id").distinct().groupBy("key").agg(F.count("doc_id").alias("n_docs"), F.max("doc_id").alias("last_doc"))


def shards_for(hot: DataFrame) -> int:
    return max(8, -(-hot.count() // SHARD_KEYS))


def _build(hot: DataFrame, n_shards: int) -> DataFrame:
    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        f = CuckooFilter(len(pdf))
        f.insert(list(pdf["key"]))
        return pd.DataFrame({"shard": [key[0]], "table": [f.to_bytes()]})

    return hot.select("key", shard_of(hot["key"], n_shards).alias("shard")).groupBy("shard").applyInPandas(build, "shard int, table binary")


def build(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
    postings = materialize(postings_of(docs, min_chars, id_col, text_col), "line-postings")
    refs = materialize(count_refs(postings), "line-refs")
    hot = refs.where(F.col("n_docs") >= min_docs)
    n_shards = shards_for(hot)
    return LineIndex(postings, refs, materialize(_build(hot, n_shards), "line-filters"), n_shards, min_chars, min_docs)


def save(index: LineIndex, path: str) -> None:
    """Writes the index below a path, which must be new, for load() in another session."""
    for name in ("postings", "refs", "filters"):
        getattr(index, name).write.option("compression", "zstd").parquet(f"{path}/{name}")
    spark = index.refs.sparkSession
    spark.createDataFrame([(index.n_shards, index.min_chars, index.min_docs)], "n_shards int, min_chars int, min_docs int").write.parquet(f"{path}/settings")  # last: it makes the index whole


def load(spark: SparkSession, path: str) -> LineIndex:
    held = spark.read.schema("n_shards int, min_chars int, min_docs int").parquet(f"{path}/settings").first()
    of = {"postings": "key binary, doc_id long, text_hash binary", "refs": "key binary, n_docs long, last_doc long", "filters": "shard int, table binary"}
    return LineIndex(*(spark.read.schema(of[n]).parquet(f"{path}/{n}") for n in of), held["n_shards"], held["min_chars"], held["min_docs"])


def _changed(index: LineIndex, postings: DataFrame, touched: DataFrame) -> LineIndex:
    """The index after postings changed in the keys of touched."""
    touched = touched.select("key").distinct()
    new = materialize(count_refs(postings.join(touched, "key", "left_semi")), "line-refs-new")
    old = index.refs.join(touched, "key", "left_semi")
    refs = materialize(index.refs.join(touched, "key", "left_anti").unionByName(new), "line-refs")
    hot = F.col("n_docs") >= index.min_docs
    up = new.where(hot).join(old.where(hot), "key", "left_anti").select("key", F.lit(True).alias("up"))
    down = old.where(hot).join(new.where(hot), "key", "left_anti").select("key", F.lit(False).alias("up"))
    n_shards = shards_for(refs.where(hot))
    if n_shards > index.n_shards:  # twice as many as needed, so that this stays rare
        filters = materialize(_build(refs.where(hot), 2 * n_shards), "line-filters")
        return LineIndex(postings, refs, filters, 2 * n_shards, index.min_chars, index.min_docs)
    delta = up.unionByName(down)
    delta = delta.select("key", "up", shard_of(delta["key"], index.n_shards).alias("shard"))

    def apply(key: tuple, was: pd.DataFrame, change: pd.DataFrame) -> pd.DataFrame:
        f = CuckooFilter(raw=was["table"].iloc[0]) if len(was) else CuckooFilter(4 * len(change))
        room = True
        if len(change):
            f.delete(list(change["key"][~change["up"].astype(bool)]))
            more = list(change["key"][change["up"].astype(bool)])
            room = f.has_room(len(more))
            f.insert(more if room else [])
        return pd.DataFrame({"shard": [key[0]], "table": [f.to_bytes() if room else None]})  # null: to be built anew

    applied = materialize(index.filters.groupBy("shard").cogroup(delta.groupBy("shard")).applyInPandas(apply, "shard int, table binary"), "line-applied")
    full = applied.where("table is null").select("shard")
    anew = refs.where(hot).withColumn("shard", shard_of(F.col("key"), index.n_shards)).join(full, "shard", "left_semi")
    filters = applied.where("table is not null").unionByName(_build(anew, index.n_shards))
    return LineIndex(postings, refs, materialize(filters, "line-filters"), index.n_shards, index.min_chars, index.min_docs)


def insert(index: LineIndex, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
    """The index with more documents in it."""
    more = materialize(postings_of(docs, index.min_chars, id_col, text_col), "line-postings-new")
    return _changed(index, index.postings.unionByName(more), more)


def delete(index: LineIndex, ids: DataFrame, id_col: str = "doc_id") -> LineIndex:
    """The index without the documents of ids, as if they had never been inserted."""
    ids = ids.select(ids[id_col].cast("long").alias("doc_id")).distinct()
    gone = index.postings.join(ids, "doc_id", "left_semi")
    kept = materialize(index.postings.join(ids, "doc_id", "left_anti"), "line-postings")
    return _changed(index, kept, materialize(gone.select("key"), "line-gone"))


def drops(index: LineIndex) -> DataFrame:
    """key, doc_id, text_hash of the postings whose lines go: filter first, exact counts after."""
    shard = lambda c: shard_of(c, index.n_shards)
    postings = index.postings.withColumn("shard", shard(F.col("key")))
    sizes = postings.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / TASK_POSTINGS).cast("int").alias("salts")).collect()  # a row a shard
    salts = index.postings.sparkSession.createDataFrame([(r["shard"], r["salts"]) for r in sizes], "shard int, salts int")
    each = F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    filters = index.filters.join(salts, "shard").select("shard", each, F.lit(0).alias("kind"), F.col("table").alias("key"), null("long", "doc_id"), null("binary", "text_hash"))
    counted = index.refs.where(F.col("n_docs") >= index.min_docs).select("key", F.col("last_doc").alias("doc_id"), shard(F.col("key")).alias("shard"))
    counted = counted.join(salts, "shard").select("shard", each, F.lit(1).alias("kind"), "key", "doc_id", null("binary", "text_hash"))
    salt = F.pmod(F.xxhash64("key", "doc_id", "text_hash"), F.col("salts")).cast("int").alias("salt")
    looked = postings.join(F.broadcast(salts), "shard").select("shard", salt, F.lit(2).alias("kind"), "key", "doc_id", "text_hash")  # salts: 12 bytes a shard
    rows = filters.unionByName(counted).unionByName(looked).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f: CuckooFilter | None = None
        counts: dict[bytes, int] = {}
        at_shard = None
        for pdf in batches:
            marks = pdf[["shard", "salt", "kind"]].to_numpy()
            starts = np.flatnonzero(np.concatenate(([True], (marks[1:] != marks[:-1]).any(1)))).tolist() if len(pdf) else []
            for at, end in zip(starts, [*starts[1:], len(pdf)], strict=True):
                part, kind, here = pdf.iloc[at:end], marks[at][2], tuple(marks[at][:2])
                if here != at_shard:
                    at_shard, f, counts = here, None, {}
                if kind == 0:
                    f = CuckooFilter(raw=bytes(part["key"].iloc[0]))
                elif kind == 1:
                    counts |= zip(map(bytes, part["key"]), part["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None), strict=True)
                elif f is not None:
                    hit = part[f.contains([bytes(k) for k in part["key"]])]
                    ids = hit["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None)
                    goes = [k in counts and counts[k] != i for k, i in zip(map(bytes, hit["key"]), ids, strict=True)]
                    if any(goes):
                        yield pd.DataFrame({"key": hit["key"][goes], "doc_id": ids[goes], "text_hash": hit["text_hash"][goes]})
        counts.clear()
        trim()

    return rows.mapInPandas(run, "key binary, doc_id long, text_hash binary")


def clean(index: LineIndex, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """docs' rows (which the index holds) with the lines removed: doc_id, n_lines, n_dropped, kept_sha256
    and, if asked, kept_text.

    A key of at least min_chars code points found in at least min_docs documents stays only in the
    largest doc_id that holds it. Rows of one doc_id are one document, in counting and in keeping.
    A null id counts for no key and never keeps one. Null or empty text is one empty line. Other
    columns are ignored. An empty table gives an empty table.
    """
    min_chars = index.min_chars
    schema = "doc_id long, n_lines long, n_dropped long, kept_sha256 string" + ", kept_text string" * with_text

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text, drop in zip(pdf["text"], pdf["drop"], strict=True):
                text = text or ""
                n, gone = text.count("\n") + 1, 0
                if drop is not None and len(drop):
                    kept = without(text, drop, min_chars)
                    gone, text = n - len(kept), "\n".join(kept)
                rows.append((n, gone, hashlib.sha256(text.encode("utf-8", "replace")).hexdigest(), text)[: 3 + with_text])
            out = pd.DataFrame(rows, columns=["n_lines", "n_dropped", "kept_sha256", "kept_text"][: 3 + with_text])
            out.insert(0, "doc_id", pdf["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None))
            yield out
        trim()

    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return _with_drops(index, own, "doc_id", "text", "drop").select("doc_id", "text", "drop").mapInPandas(run, schema)


def without(text: str, drop, min_chars: int) -> list[str]:
    """The lines of a text but those whose key is in drop."""
    drop = set(map(bytes, drop))
    return [x for x in text.split("\n") if len(x) < min_chars or line_key(x, min_chars) not in drop]


def _with_drops(index: LineIndex, docs: DataFrame, id_col: str, text_col: str, drop: str) -> DataFrame:
    """docs, all columns, with the keys that the document loses, or null, in a column called drop."""
    min_chars = index.min_chars
    d, h, own = (unused(docs, x) for x in ("__d", "__h", "__own"))
    lost = drops(index).groupBy(F.col("doc_id").alias(d), F.col("text_hash").alias(h)).agg(F.collect_set("key").alias(drop))  # at most the lines of one text

    def hashes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([text_hash(t) if t and len(t) >= min_chars else None for t in texts], dtype=object)
        trim()

    hashed = docs.withColumn(own, F.pandas_udf(hashes, "binary")(docs[text_col]))
    return hashed.join(lost, hashed[id_col].cast("long").eqNullSafe(lost[d]) & (hashed[own] == lost[h]), "left").drop(own, d, h)


def replace_text(index: LineIndex, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns and rows, with the lines removed from their texts; null text stays null."""
    min_chars = index.min_chars

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, lost in batches:
            yield pd.Series([None if t is None else "\n".join(without(t, d, min_chars)) for t, d in zip(texts, lost, strict=True)], dtype=object)
        trim()

    drop, new = unused(docs, "__drop"), unused(docs, "__new")
    rows = _with_drops(index, docs, id_col, text_col, drop)
    # the condition keeps unchanged texts out of Python: they are sent as nulls
    hit = F.col(drop).isNotNull()
    rows = rows.withColumn(new, F.pandas_udf(run, "string")(F.when(hit, F.col(text_col)), F.col(drop)))
    return rows.withColumn(text_col, F.when(hit, F.col(new)).otherwise(F.col(text_col))).select(*docs.columns)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """Builds the index of docs and cleans them with it."""
    return clean(build(docs, min_chars, min_docs, id_col, text_col), docs, id_col, text_col, with_text)
