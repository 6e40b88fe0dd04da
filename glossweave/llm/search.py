"""Ranked lexical search by a threshold-seeded join.

The index holds a row a document with the terms that questions may use, their counts and the document's length
measure. Per term it stores how many documents hold it and its largest and K-th largest impact. The K-th
impact of any of an item's terms is a lower bound of the item's K-th score, since K documents reach it by that
term alone; the largest of them seeds the item's threshold. An item's terms are ordered by the most that they can
add: those at the weak end that together stay below the threshold can't bring a document into the result on
their own and are pruned. The others generate candidates: a document's sum over them, plus all that the pruned
ones could add, must reach the threshold. Candidates are scored exactly, with all terms, and every K-th
score that a task has found raises the thresholds of its later documents. Bounds are never rounded down, and
equal ones are kept, so nothing of the result is lost.

Documents meet the items in blocks of at most BLOCK (item, term) entries (or one item), which is what goes to
the driver and is broadcast at once; the scan of the index is repeated for each block. Which terms the
index keeps is told by a bit table of fixed size, whose false hits cost room only. Statistics are sums and
bounded windows of a shuffle by term; a task gives at most K rows an item, merged in two steps.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.frequency import dense
from .common import materialize, release, trim

K = 20
SLOTS = 1 << 22  # of the bit table
BLOCK = 1 << 17
AT_ONCE = 1 << 22  # (document, item) pairs of a step
SALTS = 32
#: Fixed values of the score: scale of weights and shares, and what length and counts weigh in it.
SCALE, SHARE, FLOOR, SLOPE, DAMP = 1000, 1_000_000_000, 75, 25, 12
#: Terms are runs of ASCII letters and digits and of all other characters beyond ASCII; only A to Z change case.
_LETTERS = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def terms_of(raw: bytes) -> list[bytes]:
    """The terms of a UTF-8 text; every byte of a character beyond ASCII is 0x80 or more."""
    return raw.translate(_LETTERS).split(b" ")


def _counted(raw: bytes | None) -> tuple[Counter, int]:
    found = Counter(terms_of(raw)) if raw else Counter()
    found.pop(b"", None)
    return found, found.total()


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """rn (the item's number), item_id, term, often: the terms of the items with their repeats."""
    rows = dense(items.select(F.monotonically_increasing_id().alias("at"), F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("binary").alias("raw")), "at")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for rn, item, raw in zip(pdf["rn"], pdf["item_id"], pdf["raw"], strict=True):
                found, _ = _counted(raw)
                if found:
                    item = None if pd.isna(item) else int(item)
                    yield pd.DataFrame({"rn": rn, "item_id": pd.array([item] * len(found), "Int64"), "term": pd.Series([t.decode() for t in found], dtype=object), "often": list(found.values())})

    return rows.select("rn", "item_id", "raw").mapInPandas(run, "rn long, item_id long, term string, often long")


def slots(terms: DataFrame) -> bytes:
    """The bit table (a byte a slot) of a column term."""
    held = bytearray(SLOTS)
    for r in terms.select((F.crc32(F.col("term").cast("binary")) % SLOTS).alias("slot")).distinct().toLocalIterator():  # at most SLOTS
        held[r.slot] = 1
    return bytes(held)


def index(docs: DataFrame, keep: bytes | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (terms with repeats), terms and counts (of those in keep; of all without it). Written."""
    held = docs.sparkSession.sparkContext.broadcast(keep)  # SLOTS bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sizes, ends, terms, counts = [], [0], [], []
                for raw in part.column(1):
                    found, n = _counted(raw.as_py())
                    sizes.append(n)
                    for t, c in found.items():
                        if own is None or own[crc32(t) % SLOTS]:
                            terms.append(t)
                            counts.append(c)
                    ends.append(len(terms))
                ends = pa.array(ends, pa.int32())
                cols = [part.column(0), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(terms, pa.binary()).cast(pa.string())), pa.ListArray.from_arrays(ends, pa.array(counts, pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n", "terms", "counts"])
        trim()

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("raw"))
    return materialize(own.mapInArrow(run, "doc_id long, n long, terms array<string>, counts array<long>"), "search-index")


def measured(indexed: DataFrame) -> tuple[DataFrame, int]:
    """The index with m, a document's length measure, and the number of documents that hold a term."""
    n_docs, n_terms = indexed.where("n > 0").agg(F.count(F.lit(1)), F.sum("n")).first()
    share = F.expr(f"cast((cast({SLOPE} * n as decimal(19,0)) * cast({n_docs} as decimal(18,0))) div {max(1, n_terms or 0)} as bigint)")
    return indexed.withColumn("m", FLOOR + share), n_docs


def term_statistics(indexed: DataFrame, n_docs: int, k: int = K) -> DataFrame:
    """term, df, w (weight), most and kth: the largest and the k-th largest share of the term, 0 if fewer hold it."""
    rows = indexed.select("m", F.explode(F.arrays_zip("terms", "counts")).alias("p")).select(F.col("p.terms").alias("term"), F.col("p.counts").alias("c"), "m")
    rows = rows.selectExpr("term", f"({SHARE} * c) div ({SCALE} * c + {DAMP} * m) AS share")
    best = rows.withColumn("place", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("share")))).where(F.col("place") <= k)
    best = best.groupBy("term").agg(F.max("share").alias("most"), F.coalesce(F.min(F.when(F.col("place") == k, F.col("share"))), F.lit(0)).alias("kth"))

    def weight(dfs: pd.Series) -> pd.Series:
        return pd.Series([math.floor(SCALE * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in dfs])

    w = F.pandas_udf(weight, "long")
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(best.hint("merge"), "term").withColumn("w", w("df"))


def seeded(terms: DataFrame, stats: DataFrame) -> DataFrame:
    """item_terms() with w, threshold, needed (whether the term generates candidates) and rest: the most that the
    item's other terms can add. Terms that no document holds go. Written."""
    q = terms.join(stats.hint("merge"), "term").withColumn("bound", F.col("often") * F.col("w") * F.col("most"))
    item = Window.partitionBy("rn")  # the terms of one item
    q = q.withColumn("threshold", F.max(F.col("often") * F.col("w") * F.col("kth")).over(item))
    weakest = item.orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    q = q.withColumn("needed", F.sum("bound").over(weakest) >= F.col("threshold"))
    q = q.withColumn("rest", F.sum(F.when(F.col("needed"), 0).otherwise(F.col("bound"))).over(item))
    return materialize(q.select("rn", "item_id", "term", "often", "w", "threshold", "needed", "rest"), "search-items")


class Block:
    """Items as arrays: for each term the items that it is needed for, and those that it is not."""

    def __init__(self, rows: pd.DataFrame):
        self.items, item = np.unique(rows["rn"].to_numpy(), return_inverse=True)
        first = rows.drop_duplicates("rn").set_index("rn").loc[self.items]
        self.ids = [None if pd.isna(i) else int(i) for i in first["item_id"]]
        self.threshold, self.rest = first["threshold"].to_numpy(np.int64), first["rest"].to_numpy(np.int64)
        self.terms, term = np.unique(rows["term"].to_numpy(dtype=str), return_inverse=True)
        self.weight = np.zeros(len(self.terms), np.int64)
        self.weight[term] = rows["w"]
        needed = rows["needed"].to_numpy(bool)
        self.needed, self.pruned = (self._by_term(term[x], item[x], rows["often"].to_numpy(np.int64)[x]) for x in (needed, ~needed))

    def _by_term(self, term: np.ndarray, item: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(term, kind="stable")
        return np.searchsorted(term[order], np.arange(len(self.terms) + 1)), item[order], often[order]

    def add(self, sums: np.ndarray, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, side: tuple) -> None:
        """Adds the impacts of (doc, term) to sums[doc, item] for the side's items of each term."""
        starts, item, often = side
        n = starts[term + 1] - starts[term]
        at = np.repeat(starts[term] - np.cumsum(n) + n, n) + np.arange(n.sum())
        np.add.at(sums, (np.repeat(doc, n), item[at]), np.repeat(impact, n) * often[at])


class Best:
    """The best k documents of each item so far."""

    def __init__(self, block: Block, k: int):
        self.k, self.threshold = k, block.threshold.copy()
        self.kept = [np.zeros(0, np.int64) for _ in range(4)]  # item, score, 1 for a null id, id

    def meet(self, item: np.ndarray, score: np.ndarray, null: np.ndarray, doc_id: np.ndarray) -> None:
        rows = [np.concatenate(x) for x in zip(self.kept, (item, score, null, doc_id), strict=True)]
        order = np.lexsort((rows[3], rows[2], -rows[1], rows[0]))
        rows = [x[order] for x in rows]
        place = np.arange(len(order)) - np.searchsorted(rows[0], rows[0])
        full = rows[0][place == self.k - 1]
        self.threshold[full] = np.maximum(self.threshold[full], rows[1][place == self.k - 1])
        self.kept = [x[place < self.k] for x in rows]


def _scored(indexed: DataFrame, block: Block, k: int) -> DataFrame:
    """rn, item_id, doc_id, score: the best k documents of each item of the block in every task."""
    held = indexed.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        best, known, wide = Best(own, k), pa.array(own.terms.tolist(), pa.string()), len(own.items)
        step = max(1, min(1024, AT_ONCE // wide))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                lists = part.column(2)
                sizes = np.diff(lists.offsets.to_numpy())
                term = pc.fill_null(pc.index_in(lists.flatten(), value_set=known), -1).to_numpy()
                count, doc = part.column(3).flatten().to_numpy(), np.repeat(np.arange(part.num_rows), sizes)
                met = term >= 0
                term, count, doc = term[met].astype(np.int64), count[met], doc[met]
                impact = own.weight[term] * (SHARE * count // (SCALE * count + DAMP * part.column(1).to_numpy()[doc]))
                sums = np.zeros((part.num_rows, wide), np.int64)
                own.add(sums, doc, term, impact, own.needed)
                some = (sums > 0) & (sums + own.rest >= best.threshold)
                hit = some.any(axis=1)[doc]
                own.add(sums, doc[hit], term[hit], impact[hit], own.pruned)  # now exact where it matters
                doc, item = np.nonzero(some & (sums >= best.threshold))
                if len(doc):
                    ids = part.column(0)
                    best.meet(item, sums[doc, item], ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64)[doc], pc.fill_null(ids, 0).to_numpy()[doc])
        item, score, null, doc_id = best.kept
        yield pa.RecordBatch.from_arrays([pa.array(own.items[item]), pa.array([own.ids[i] for i in item], pa.int64()), pa.array(doc_id, mask=null.astype(bool)), pa.array(score)], names=["rn", "item_id", "doc_id", "score"])
        trim()

    return indexed.select("doc_id", "m", "terms", "counts").mapInArrow(run, "rn long, item_id long, doc_id long, score long")


def _first(rows: DataFrame, k: int, *by) -> DataFrame:
    order = Window.partitionBy("rn", *by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rank(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: for each row of items the k documents of the highest score above 0, or
    all if they are fewer; equal scores by ascending doc_id, null ids last.

    Null and empty texts have no terms: such documents are in no result and do not count, such items have none.
    Repeated documents are documents each, with scores and ranks of their own; repeated items and items without id are
    answered each. Other columns are ignored. Empty tables give an empty table.
    """
    terms = materialize(item_terms(items), "search-terms")
    indexed, n_docs = measured(index(docs, slots(terms)))
    asked = seeded(terms, term_statistics(indexed, n_docs, k))
    most = asked.groupBy("rn").count().agg(F.max("count"), F.count(F.lit(1))).first()[0] or 1
    size = max(1, BLOCK // most)
    found = None
    last = terms.agg(F.coalesce(F.max("rn"), F.lit(0))).first()[0]
    for at in range(0, last, size):
        rows = asked.where((F.col("rn") > at) & (F.col("rn") <= at + size)).toPandas()  # at most BLOCK rows or an item
        if len(rows):
            part = _first(_scored(indexed, Block(rows), k), k, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).drop("rank")
            found = part if found is None else found.unionByName(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    done = materialize(_first(found, k).select("item_id", "rank", "doc_id", "score"), "search-ranks")
    release(terms, asked)
    return done
