"""Ordered replacement with dictionaries of any size: a joined index instead of a list at every worker.

The result is the fold of apply.fold(): pairs in order (longest key first, ties by position), each replacing all
occurrences of its key in what the earlier ones left. Of a large dictionary only few pairs can fire in a text,
and they are found by a join. A key is indexed by its anchor, the hash of its first characters (up to LONGEST);
a text's anchors that a bit table knows are joined with the index, which gives its candidates. The table grows with
the pairs, so that few anchors pass that no key has (up to MOST_BITS, past which more pass and are dropped by the
join). The text is folded with these alone. Wherever a replacement makes new text, the table is asked for the anchors
of all places where a key whose turn is later, so no longer than the one replaced, could touch it. Where it knows one
that has not been joined yet, the fold stops at the first turn that a key with it can have; these anchors are
joined likewise, and the fold goes on from there. So every key that is in a text at its turn is a candidate by then, the
fold is exact, and each pair is applied at its turn and not again. The work at a text follows its length and
what fires in it, not the number of pairs; nothing but the longest key's length, the anchors' lengths and the bit
table goes to the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.tables import materialize, release

LONGEST = 16  # characters of an anchor
KEY_BITS, LEAST_BITS, MOST_BITS = 16, 20, 30  # bits of the table a key at least; log2 of the table's bits
CHUNK_BITS, HEAD_BITS = 20, 16  # log2 of the bits that one task puts together; of the table of first characters
FACTOR = np.uint64(0x9E3779B97F4A7C15)
SPREAD = [(np.uint64(s), np.uint64(c)) for s, c in ((0, 0xC2B2AE3D27D4EB4F), (31, 0xD6E8FEB86659FD93), (27, 0x94D049BB133111EB))]  # a bit an anchor each
LOOK = 1 << 20  # anchors or characters of texts at once
FIRST = -(1 << 63)  # before all positions
_PROTECTED = re.compile(rf"({re.escape(T.DIM)}|\\[A-Za-z](?:[^\\<]+|<(?!>))*)")
_INDEX = "anchor long, neg long, pos long, en string, ru string"
_FOLDED = (
    "tid long, text string, out string, parts array<string>, pairs array<struct<neg:long,pos:long,en:string,ru:string>>, asked array<long>,"
    " fresh array<long>, neg long, pos long"
)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)


def _longer(h: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The hashes of strings one character longer."""
    return (h ^ (h >> np.uint64(29))) * FACTOR + code


def _flat(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The characters of all strings, one after the other, and where each string begins, and the end. No nulls."""
    kind = np.int64 if pa.types.is_large_string(strings.type) else np.int32
    _, ends, data = strings.buffers()
    at = np.frombuffer(ends, kind)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64) if len(strings) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    at = at - at[0]
    if not len(raw) or raw.max() < 0x80:
        return raw.astype(np.uint64) + np.uint64(1), at
    before = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return _codes(raw.tobytes().decode()), before[at]


def _anchors(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The anchor of each string of _flat(): the hash of its first characters."""
    begin, own = at[:-1], np.minimum(np.diff(at), LONGEST)
    h, all_have = np.zeros(len(own), np.uint64), int(own.min(initial=LONGEST))
    for c in range(int(own.max(initial=0))):
        if c < all_have:
            h = _longer(h, codes[begin + c])
        else:
            rows = np.flatnonzero(own > c)
            h[rows] = _longer(h[rows], codes[begin[rows] + c])
    return h.astype(np.int64)


def key_anchors(keys: list[str]) -> np.ndarray:
    return _anchors(*_flat(pa.array(keys, pa.string())))


@dataclass(frozen=True)
class Table:
    """Which anchors keys may have: bits, the pairs of characters that longer keys begin with (likewise), and the lengths
    of anchors that any key has."""

    bits: np.ndarray
    heads: np.ndarray
    lengths: tuple[int, ...]

    def found(self, text: str | np.ndarray, room: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places in a text (or its codes) and their anchors, of those that the table knows, by length. room: the longest
        anchor to look for at each place, if that is not all up to the text's end."""
        codes = _codes(text) if isinstance(text, str) else text
        at, h = np.arange(len(codes)), np.zeros(len(codes), np.uint64)
        room = len(codes) - at if room is None else room
        for n in range(1, max(self.lengths, default=0) + 1):
            fits = room >= n
            if not fits.all():
                at, h, room = at[fits], h[fits], room[fits]
            h = _longer(h, codes[at + (n - 1)])
            if n == 2:
                begun = self.heads[_slot(h, 0, HEAD_BITS)] != 0
                at, h, room = at[begun], h[begun], room[begun]
            if n in self.lengths:
                of = self.known(h)
                yield at[of], h[of]

    def known(self, h: np.ndarray) -> np.ndarray:
        """The places in h of anchors that the table knows."""
        size = int(self.bits.size).bit_length() + 2
        at = np.arange(len(h))
        for which in range(len(SPREAD)):
            slot = _slot(h[at] if which else h, which, size)
            at = at[(self.bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 != 0]
        return at


def _slot(h: np.ndarray, which: int, size: int) -> np.ndarray:
    """The place of an anchor's bit in a table of 1 << size bits."""
    shift, factor = SPREAD[which]
    return (((h ^ (h >> shift) if shift else h) * factor) >> np.uint64(64 - size)).astype(np.int64)


def index(pairs: DataFrame) -> DataFrame:
    """pairs: pos, en, ru. The index, written; empty keys go. neg is minus the key's length, so that (neg, pos) is
    the order of the pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, at = _flat(batch.column("en"))
            own = [pa.array(_anchors(codes, at)), pa.array(at[:-1] - at[1:])]
            yield pa.RecordBatch.from_arrays([*own, *(batch.column(c) for c in ("pos", "en", "ru"))], ["anchor", "neg", "pos", "en", "ru"])

    own = pairs.select(F.col("pos").cast("long").alias("pos"), "en", F.coalesce("ru", F.lit("")).alias("ru")).where("en <> ''")
    return materialize(own.mapInArrow(run, _INDEX), "pair-index")


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Anchors, some LOOK at once, and the first characters of their keys, once each."""
    kept, heads, n = [], set(), 0
    for batch in batches:
        kept.append(batch.column("anchor").to_numpy())
        heads.update(pc.unique(batch.column("head")).to_pylist())
        n += batch.num_rows
        if n >= LOOK:
            yield np.concatenate(kept), sorted(heads)
            kept, heads, n = [], set(), 0
    if n:
        yield np.concatenate(kept), sorted(heads)


def bit_table(indexed: DataFrame) -> tuple[Table, int]:
    """The table of an index's anchors, put together in chunks of fixed size, and the longest key's length."""
    of = indexed.agg(F.count("neg").alias("n"), F.min("neg").alias("longest"), F.collect_set(F.least(F.lit(LONGEST), -F.col("neg"))).alias("sizes")).first()
    size = min(MOST_BITS, max(LEAST_BITS, (KEY_BITS * of["n"]).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, heads in _gathered(batches):
            slot = np.concatenate([_slot(h.astype(np.uint64), which, size) for which in range(len(SPREAD))])
            slot = slot[np.argsort((slot >> CHUNK_BITS).astype(np.uint16), kind="stable")]
            chunk, first = np.unique(slot >> CHUNK_BITS, return_index=True)
            inside = (slot & ((1 << CHUNK_BITS) - 1)).astype("<u4")
            ends = np.append(first, len(slot)).astype(np.int32) * 4
            slots = pa.Array.from_buffers(pa.binary(), len(chunk), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(inside.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(chunk), slots], ["chunk", "slots"])
            heads = np.unique(_slot(key_anchors(heads).astype(np.uint64), 0, HEAD_BITS)).astype("<u4")
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([heads.tobytes()])], ["chunk", "slots"])

    def together(pdf: pd.DataFrame) -> pd.DataFrame:
        marks = np.zeros(1 << CHUNK_BITS, np.uint8)
        marks[np.frombuffer(b"".join(pdf["slots"]), "<u4")] = 1
        return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1], "bits": [np.packbits(marks, bitorder="little").tobytes()]})

    slots = indexed.select("anchor", F.left("en", F.lit(2)).alias("head")).mapInArrow(run, "chunk long, slots binary")
    chunks = materialize(slots.groupBy("chunk").applyInPandas(together, "chunk long, bits binary"), "anchor-bits")
    table, heads, wide = np.zeros(1 << (size - 3), np.uint8), np.zeros(1 << HEAD_BITS, np.uint8), 1 << (CHUNK_BITS - 3)
    for r in chunks.toLocalIterator():
        some = np.frombuffer(r["bits"], np.uint8)
        if r["chunk"] < 0:
            heads = np.unpackbits(some, bitorder="little")[: 1 << HEAD_BITS]
        else:
            table[r["chunk"] * wide : (r["chunk"] + 1) * wide] = some
    release(chunks)
    return Table(table, heads, tuple(sorted(of["sizes"]))), -(of["longest"] or -1)


def _asked(texts: DataFrame, held) -> DataFrame:
    """tid, anchor: the anchors in each text that the table knows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        for batch in batches:
            ids, texts = batch.column("tid").to_numpy(), batch.column("text")
            codes, at = _flat(texts)
            begin = 0
            while begin < len(ids):
                end = max(begin + 1, int(np.searchsorted(at, at[begin] + LOOK, "right")) - 1)
                own = at[begin : end + 1] - at[begin]
                room = np.repeat(own[1:], np.diff(own)) - np.arange(own[-1])
                row, anchor = _rows(table.found(codes[at[begin] : at[end]], room), own)
                row, anchor = _once(row, anchor)
                yield pa.RecordBatch.from_arrays([pa.array(ids[begin + row]), pa.array(anchor)], ["tid", "anchor"])
                begin = end

    return texts.select("tid", "text").mapInArrow(run, "tid long, anchor long")


def _rows(found: Iterator[tuple[np.ndarray, np.ndarray]], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor found the string of _flat() that has it, and the anchor."""
    both = [*found]
    place = np.concatenate([np.zeros(0, np.int64), *(p for p, _ in both)])
    return np.searchsorted(at, place, "right") - 1, np.concatenate([np.zeros(0, np.int64), *(h.astype(np.int64) for _, h in both)])


def _once(*columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of rows that agree in the first two columns the least."""
    order = np.lexsort(columns[::-1])
    columns = tuple(c[order] for c in columns)
    first = np.ones(len(order), bool)
    first[1:] = (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])
    return tuple(c[first] for c in columns)


def _list(column: pa.Array) -> list:
    return column.to_numpy(zero_copy_only=False).tolist()


def _counts(column: pa.Array) -> np.ndarray:
    """How many values each row of a list column has."""
    return pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)


def _dealt(counts: np.ndarray, values: pa.Array) -> pa.Array:
    """A list column of values in order, so many a row."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)


class Made:
    """Stretches of text that replacements made: the text's number, the order of the pair, and in how many of the
    stretch's places keys may begin."""

    def __init__(self):
        self.rows: list[tuple[int, int, int, str, int]] = []
        self.chars = 0

    def note(self, of: int, neg: int, pos: int, text: str, between: list[str], n: int) -> None:
        """A later key, which is no longer than this one, that touches or spans a replacement begins less than that
        before its end; stretches that overlap are one."""
        more = min(LONGEST, -neg) - 1
        at = len(between[0])
        low, high = max(0, at + neg + 1), at + n
        for part in between[1:-1]:
            at = high + len(part)
            if at + neg + 1 > high:
                self.rows.append((of, neg, pos, text[low : high + more], high - low))
                self.chars += high + more - low
                low = at + neg + 1
            high = at + n
        self.rows.append((of, neg, pos, text[low : high + more], high - low))
        self.chars += high + more - low

    def fresh(self, table: Table, of: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """The known anchors of what was made that were not asked for (of: the text, in order; asked: the anchor), once a text, in the texts'
        order: rows of text, anchor, and the first turn that a key with it can have (neg, pos)."""
        found = [np.zeros((0, 4), np.int64)]
        if self.rows:
            text, neg, pos, made, places = zip(*self.rows, strict=True)
            text, neg, pos, places, size = (np.array(x, np.int64) for x in (text, neg, pos, places, [*map(len, made)]))
            codes, row = _codes("".join(made)), np.repeat(np.arange(len(size)), size)
            inside = np.arange(len(codes)) - (np.cumsum(size) - size)[row]
            most = np.where(neg > -LONGEST, -neg, LONGEST)  # later keys are no longer
            room = np.where(inside < places[row], np.minimum(size[row] - inside, most[row]), 0)
            for n, (place, h) in zip(table.lengths, table.found(codes, room), strict=False):
                r = row[place]
                later = (n < LONGEST) & (neg[r] < -n)  # of a shorter anchor the key's length is known
                found.append(np.column_stack([text[r], h.astype(np.int64), np.where(later, -n, neg[r]), np.where(later, FIRST, pos[r] + 1)]))
            some = slice(*np.searchsorted(of, [text[0], text[-1] + 1]))
            found.append(np.column_stack([of[some], asked[some], *(np.full(len(of[some]), FIRST) for _ in range(2))]))  # the least stands for all
        every = np.column_stack(_once(*np.concatenate(found).T))
        return every[every[:, 2] != FIRST]


def _replaced(text: str, en: list[str], ru: list[str]) -> str:
    for a, b in zip(en, ru, strict=True):
        if a in text:
            text = text.replace(a, b)
    return text


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables in which the rows of a tid are together and whole, of batches in the order of tid."""
    kept, last = [], None
    for batch in (b for b in batches if b.num_rows):
        tid = batch.column("tid").to_numpy()
        begin = int(np.searchsorted(tid, tid[-1]))  # where the last one begins, which may go on
        if begin or tid[0] != last:
            kept.append(batch.slice(0, begin))
            if any(b.num_rows for b in kept):
                yield pa.Table.from_batches(kept).combine_chunks()
            kept = []
        kept.append(batch.slice(begin))
        last = tid[-1]
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks()


def _fold(rows: DataFrame, held, protect: bool) -> DataFrame:
    """rows: tid, text, and on rows of their own pos, en, ru of the text's new candidates, of the first ones also the anchor;
    of a fold that goes on the text's parts as they are (every second one is protected), the pairs whose turn is to come, and the anchors asked
    for. A row a text: out, or such parts, pairs and anchors, the fresh ones, and the turn at which the fold stopped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        for rows in _runs(batches):
            yield _folded({c: rows.column(c).chunk(0) for c in rows.column_names}, table, protect)

    return rows.repartition("tid").sortWithinPartitions("tid").mapInArrow(run, _FOLDED)  # as many as a text has places for


def _folded(column: dict[str, pa.Array], table: Table, protect: bool) -> pa.RecordBatch:
    is_text = column["text"].is_valid().to_numpy(zero_copy_only=False)
    tid = column["tid"].to_numpy()
    group = np.cumsum(np.concatenate([[True], tid[1:] != tid[:-1]])) - 1
    own, new = pa.array(np.flatnonzero(is_text)), pa.array(np.flatnonzero(~is_text))
    n, texts = len(own), column["text"].take(own)

    # the candidates of all texts in order, and the anchors asked for
    of, pos, en, ru = group[~is_text], *(column[c].take(new) for c in ("pos", "en", "ru"))
    if "parts" in column:
        some = {c: column[c].take(own) for c in ("parts", "pairs", "asked")}
        flat, ends = _list(some["parts"].flatten()), np.concatenate([[0], np.cumsum(_counts(some["parts"]))]).tolist()
        parts = [flat[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        left = some["pairs"].flatten()
        of = np.concatenate([np.repeat(np.arange(n), _counts(some["pairs"])), of])
        pos, en, ru = (pa.concat_arrays([left.field(c), x]) for c, x in (("pos", pos), ("en", en), ("ru", ru)))
        asked_of, asked, longest = np.repeat(np.arange(n), _counts(some["asked"])), some["asked"].flatten().to_numpy(), None
    else:
        parts = [_PROTECTED.split(t) if protect and ("\\" in t or T.DIM in t) else [t] for t in _list(texts)]
        asked_of, asked, longest = of, column["anchor"].take(new).to_numpy(), -pc.utf8_length(en).to_numpy().astype(np.int64)
    pos, neg = pos.to_numpy(), -pc.utf8_length(en).to_numpy().astype(np.int64)
    order = np.lexsort((pos, neg, of))
    of, pos, neg, en, ru = of[order], pos[order], neg[order], en.take(pa.array(order)), ru.take(pa.array(order))
    ends, ens, rus, negs, poss = np.searchsorted(of, np.arange(n + 1)).tolist(), _list(en), _list(ru), neg.tolist(), pos.tolist()

    folds, last, made, fresh = [], [], Made(), []
    note = made.note
    for g in range(n):
        begin, end, fired = ends[g], ends[g + 1], -1
        if begin == end:
            folds.append(parts[g])
            last.append(fired)
            continue
        folded = parts[g].copy()
        for i in range(0, len(folded), 2):
            text = folded[i]
            if text:
                for k in range(begin, end):
                    key = ens[k]
                    if key in text and key != (value := rus[k]):
                        between = text.split(key)
                        text = value.join(between)
                        note(g, negs[k], poss[k], text, between, len(value))
                        fired = max(fired, k)
                folded[i] = text
        folds.append(folded)
        last.append(fired)
        if made.chars > LOOK:
            fresh.append(made.fresh(table, asked_of, asked))
            made = Made()
            note = made.note
    fresh = np.concatenate([*fresh, made.fresh(table, asked_of, asked)])

    # where there are fresh anchors the fold stops at the first turn that their keys can have
    turns = fresh[np.lexsort((fresh[:, 3], fresh[:, 2], fresh[:, 0]))]
    turns = turns[np.concatenate([[True], turns[1:, 0] != turns[:-1, 0]])[: len(turns)]]
    stopped, left, count = turns[:, 0].tolist(), [], np.zeros((3, n), np.int64)
    done, flat = ["".join(x) for x in folds], []
    for g, _, stop_neg, stop_pos in turns.tolist():
        begin, end = ends[g], ends[g + 1]
        at = begin
        while at < end and (negs[at] < stop_neg or (negs[at] == stop_neg and poss[at] < stop_pos)):
            at += 1
        kept = folds[g] if last[g] < at else [x if i % 2 else _replaced(x, ens[begin:at], rus[begin:at]) for i, x in enumerate(parts[g])]
        flat += kept
        left += range(at, end)
        done[g], count[0, g], count[1, g] = None, len(kept), end - at
    turn = np.zeros((2, n), np.int64)
    turn[:, stopped] = turns[:, 2:].T
    going = np.zeros(n, bool)
    going[stopped] = True
    more = going[asked_of] if longest is None else going[asked_of] & (longest >= turn[0, asked_of])  # a longer one's turn is over
    at = pa.array(np.array(left, np.int64))
    pairs = pa.StructArray.from_arrays([pa.array(neg).take(at), pa.array(pos).take(at), en.take(at), ru.take(at)], ["neg", "pos", "en", "ru"])
    out = {
        "tid": column["tid"].take(own),
        "text": texts,
        "out": pa.array(done, pa.string()),
        "parts": _dealt(count[0], pa.array(flat, pa.string())),
        "pairs": _dealt(count[1], pairs),
        "asked": _dealt(np.bincount(asked_of[more], minlength=n), pa.array(asked[more])),
        "fresh": _dealt(np.bincount(fresh[:, 0], minlength=n), pa.array(fresh[:, 1])),
        "neg": pa.array(turn[0], mask=~going),
        "pos": pa.array(turn[1], mask=~going),
    }
    return pa.RecordBatch.from_pydict(out)


def replaced(texts: DataFrame, pairs: DataFrame, protect: bool = True) -> DataFrame:
    """texts: a column text. pairs: pos (unique), en, ru. text, out: every distinct text that is not null, folded.

    Null keys and empty ones do nothing, a null value deletes its key. Of pairs with one key the first by pos fires; the
    others only on what has been made since. An empty dictionary leaves the texts as they are.
    """
    spark = texts.sparkSession
    keys = index(pairs)
    table, _ = bit_table(keys)
    held = spark.sparkContext.broadcast(table)  # 1 << MOST_BITS bits at most
    own = materialize(texts.select("text").where("text is not null").distinct().withColumn("tid", F.monotonically_increasing_id()), "fold-texts")
    found = _asked(own, held).join(keys, "anchor").select("tid", "anchor", "pos", "en", "ru")
    state, done = own, None
    while True:
        last = materialize(_fold(state.unionByName(found, allowMissingColumns=True), held, protect), "fold-round")
        settled = last.where("out is not null").select("text", "out")
        done = settled if done is None else done.unionByName(settled)
        state = last.where("out is null")
        if state.isEmpty():
            return done
        asks = state.select("tid", F.explode("fresh").alias("anchor"), F.col("neg").alias("from_neg"), F.col("pos").alias("from_pos"))
        later = (F.col("neg") > F.col("from_neg")) | ((F.col("neg") == F.col("from_neg")) & (F.col("pos") >= F.col("from_pos")))
        found = asks.join(keys, "anchor").where(later).select("tid", "pos", "en", "ru")
        state = state.select("tid", "text", "parts", "pairs", F.concat("asked", "fresh").alias("asked"))
