"""Near-duplicates by SetSketch.

A document's set of word shingles is hashed to 64 bits each and summarised by M registers: every
element throws exponentially spaced points at random registers, a register keeps its minimum, truncated
to a whole power of BASE. Registers of a union are the larger ones of the parts (mergeable()), and two
sets agree in a register about as often as their Jaccard similarity. Documents of one set are one
class from the start. Classes that agree in a band of ROWS registers are candidates; for a candidate
the joint likelihood of the greater, smaller and equal registers, at the known set sizes, is compared
at its best similarity and at the threshold, and what is not ruled out is confirmed on the full sets.
With 42 bands of 6 registers a pair of similarity 0.8 is missed with probability 3e-6.

Links are needed only between classes that are not connected yet. So a bucket is not expanded into its
pairs: in two rounds all members meet one of them (the smallest, then one drawn at random) and links
are contracted to components. What is still apart is compared bucket by bucket: members outside a
bucket's largest component are held against those of other components, in blocks of at most some BLOCK
times BLOCK members, fewer where texts are long, that carry registers but no texts; a pair that shares several buckets is taken up
in the first. Of what the registers do not rule out a block lists each member's partners, and the block's
members that have any meet again with their texts, where the pairs are confirmed on the full sets; only
links leave, so no table of pairs is made. No pair that could add a link is left out. Buckets of more than
HOT members are dealt out by a salt, and so is the text of a bucket's head; copies go through partial
aggregates.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dealt_join, heavy, materialize, release, trim, unused
from .components import components

M, ROWS, BASE, RATE = 252, 6, 1.001, 20.0
BANDS = M // ROWS
ROUNDS = 2
#: Log-likelihood by which the threshold must fall short of the best similarity (five deviations).
RULED_OUT = 12.5
CACHE_WORDS = 100_000
HOT = 1024  # members of a bucket that one task may join
SOME, SOME_CHARS = 512, 4_000_000  # documents sketched together, and their code points (one at least)
ELEMENTS = 500_000
BLOCK, BLOCK_SHINGLES = 512, 1 << 21  # members a side of a block, and their shingles (a longer set is alone), about
PAIRS = 16_384  # pairs whose registers are compared at once
_GOLD, _MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_WORDS = Words()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, k: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's k-word shingles, A-Z lower-cased; of fewer than k
    words, that of the whole sequence; none without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    n = min(k, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - n + 1, n, np.uint64)
        for j in range(n):
            out = mixed(out + _GOLD + h[j : j + len(out)])
    return np.unique(out)


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """One row of M registers (uint16) for each set; 0 for an empty one."""
    out = np.zeros((len(sets), M), np.uint16)
    todo, reach = [i for i, s in enumerate(sets) if len(s)], 4.0
    while todo:
        sizes = np.array([len(sets[i]) for i in todo])
        least = np.full((len(todo), M), np.inf)
        limit = (np.log(M) + reach) / (sizes * RATE)
        every, owner = np.concatenate([sets[i] for i in todo]), np.repeat(np.arange(len(todo)), sizes)
        for at in range(0, len(every), ELEMENTS):  # minima of parts merge
            _throw(every[at : at + ELEMENTS], owner[at : at + ELEMENTS], limit, least)
        done = least.max(1) <= limit  # no later point can lower a register
        value = np.floor(1 - np.log(least[done]) / np.log(BASE))
        out[np.array(todo)[done]] = np.clip(value, 0, 65535).astype(np.uint16)
        todo, reach = [i for i, d in zip(todo, done, strict=True) if not d], reach + 8
    return out


def _throw(elements: np.ndarray, owner: np.ndarray, limit: np.ndarray, least: np.ndarray) -> None:
    """Lowers the registers by all points below the owner's limit."""
    flat = least.reshape(-1)
    with np.errstate(over="ignore"):
        x, state, j = np.zeros(len(elements)), mixed(elements + _GOLD), 0
        while len(state):
            block = max(1, min(64, 100_000 // len(state)))
            steps = np.arange(j + 1, j + 1 + block, dtype=np.uint64) * _GOLD
            r = mixed(state[:, None] + steps)
            u = ((r >> np.uint64(32)).astype(np.float64) + 0.5) / 4294967296.0
            at = x[:, None] + np.cumsum(-np.log(u), 1) / (M * RATE)
            register = ((r & np.uint64(0xFFFFFFFF)) * np.uint64(M)) >> np.uint64(32)
            row, col = np.nonzero(at <= limit[owner][:, None])
            np.minimum.at(flat, owner[row] * M + register[row, col].astype(np.int64), at[row, col])
            x, j = at[:, -1], j + block
            on = x <= limit[owner]
            x, state, owner = x[on], state[on], owner[on]


def mergeable(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union."""
    return np.maximum(a, b)


def _log_likelihood(j: np.ndarray, u: float, v: float, more: int, less: int) -> np.ndarray:
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    a, b = p(u - v * j), p(v - u * j)
    tiny = 1e-12
    return more * np.log(np.maximum(a, tiny)) + less * np.log(np.maximum(b, tiny)) + (M - more - less) * np.log(np.maximum(1 - a - b, tiny))


def estimate(a: np.ndarray, b: np.ndarray, na: int, nb: int, threshold: float) -> tuple[float, bool]:
    """The likeliest similarity of sets of na and nb elements, and whether the threshold or more is ruled out."""
    u, v = na / (na + nb), nb / (na + nb)
    grid = np.linspace(0, min(u / v, v / u), 201)
    ll = _log_likelihood(grid, u, v, int((a > b).sum()), int((a < b).sum()))
    above = ll[grid >= threshold - 0.003]
    return float(grid[ll.argmax()]), not len(above) or bool(ll.max() - above.max() > RULED_OUT)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def document_key(doc_id: Column, text: Column) -> Column:
    """16 bytes that stand for an id (or its lack) and a text: rows that share them are one document."""
    return F.unhex(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("none")), F.lit(" "), F.coalesce(text, F.lit("")))))


def _sketched(docs: DataFrame, k: int) -> DataFrame:
    """docs: doc_id, doc_key, text. Gives doc_id, doc_key, n, set_id (128 bits), regs (2 bytes a register;
    null if empty)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ends = np.cumsum([len(t) if t else 0 for t in pdf["text"]])
            at = 0
            while at < len(pdf):
                end = min(at + SOME, max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SOME_CHARS))))
                part, at = pdf.iloc[at:end], end
                sets = [shingles(t, k) for t in part["text"]]
                regs = sketch(sets)
                yield pd.DataFrame(
                    {
                        "doc_id": part["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None),
                        "doc_key": part["doc_key"].to_numpy(),
                        "n": [len(s) for s in sets],
                        "set_id": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
                        "regs": [r.astype(">u2").tobytes() if len(s) else None for r, s in zip(regs, sets, strict=True)],
                    }
                )
        _WORDS.clear()
        trim()

    return docs.mapInPandas(run, "doc_id long, doc_key binary, n long, set_id binary, regs binary")


def _classes(rows: DataFrame) -> DataFrame:
    """One row a set: node (a number of its own, fixed as the table is written), set_id, n, regs, and first,
    the smallest id of its documents (those without one come last) with that document's key."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "doc_key")).alias("first")
    one = rows.where("n > 0").groupBy("set_id").agg(first, F.max("n").alias("n"), F.min("regs").alias("regs"))  # n and regs are the same for all
    return one.select(F.monotonically_increasing_id().alias("node"), "set_id", "n", "regs", "first")


def _confirmed(pairs: DataFrame, full: DataFrame, k: int, percent: int) -> DataFrame:
    """pairs: u, v and salt, which spreads a v that meets many: each salt has a copy of its text; full: node, n,
    regs, text. The pairs whose full sets are similar enough."""
    named = lambda x: [F.col("node").alias(x), *(F.col(c).alias(c[0] + x) for c in ("n", "regs", "text"))]
    heads = full.join(pairs.select(F.col("v").alias("node"), "salt").distinct(), "node")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: dict[int, np.ndarray] = {}  # the sets of a few documents met last
        size = 0

        def own(node: int, text: str) -> np.ndarray:
            nonlocal size
            if node not in last:
                if size > 4_000_000 or len(last) > 512:
                    last.clear()
                    size = 0
                last[node] = shingles(text, k)
                size += len(last[node])
            return last[node]

        for pdf in batches:
            keep = np.zeros(len(pdf), bool)
            for i, (u, v, nu, nv, ru, rv, tu, tv) in enumerate(zip(*(pdf[c] for c in ("u", "v", "nu", "nv", "ru", "rv", "tu", "tv")), strict=True)):
                out = estimate(np.frombuffer(ru, ">u2"), np.frombuffer(rv, ">u2"), nu, nv, percent / 100)[1]
                keep[i] = not out and similar(own(u, tu), own(v, tv), percent)
            yield pdf.loc[keep, ["u", "v"]]
        last.clear()
        _WORDS.clear()
        trim()

    joined = pairs.join(full.select(*named("u")), "u").join(heads.select(*named("v"), "salt"), ["v", "salt"])
    return joined.mapInPandas(run, "u long, v long")


def _own(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    doc_id, text = docs[id_col].cast("long"), docs[text_col]
    return docs.select(doc_id.alias("doc_id"), document_key(doc_id, text).alias("doc_key"), text.alias("text"))


def _linked(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """One row a row of docs: doc_id, doc_key, n, and g: the first document (as in _classes) of its component;
    null for an empty set."""
    own = _own(docs, id_col, text_col)
    rows = materialize(_sketched(own, k), "near-rows")
    classes = materialize(_classes(rows), "near-classes")
    bands = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1)))
    bucket = F.xxhash64("band", F.substring("regs", F.col("band") * (2 * ROWS) + 1, F.lit(2 * ROWS)))
    banded = classes.select("node", "n", "regs", bands.alias("band")).select(bucket.alias("bucket"), "node", "n", F.col("band").cast("byte").alias("band"))
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("bucket", "c", F.ceil(F.col("c") / HOT).cast("int").alias("salts"))
    shared = materialize(shared, "near-buckets")
    hot = heavy(shared, "c", HOT).select("bucket", F.col("salts").alias("parts"))
    salt = F.pmod(F.xxhash64("node"), F.col("salts")).cast("int")
    members = dealt_join(banded, shared.select("bucket", "salts"), "bucket", hot, "node").withColumn("salt", salt)
    members = materialize(members, "near-members")
    release(shared)
    labels = materialize(members.select("node").distinct().select("node", F.col("node").alias("label")), "near-labels")
    # the text of each candidate class is that of its first document
    held = classes.join(labels.select("node"), "node", "left_semi").select("node", "n", "regs", F.col("first.doc_key").alias("doc_key"))
    texts = own.select("doc_key", "text").join(held.select("doc_key", "node"), "doc_key").groupBy("node").agg(F.min("text").alias("text"))
    full = materialize(held.select("node", "n", "regs").join(texts, "node"), "near-full")
    written = members
    for r in range(ROUNDS + 1):
        now = materialize(members.join(labels, "node"), "near-now")
        met = materialize(_with_heads(now, r), "near-open")
        release(now, written)
        if met.isEmpty():
            break
        if r < ROUNDS:
            close = F.least("n", "nv") * 100 >= percent * F.greatest("n", "nv")
            pairs = met.where((F.col("label") != F.col("lv")) & close).groupBy(F.col("node").alias("u"), "v").agg(F.max("salt").alias("salt"))
            found, check = materialize(pairs, "near-pairs"), _confirmed
        else:
            found, check = materialize(_across(met, full, percent), "near-partners"), _confirmed_blocks
        links = materialize(check(found, full, k, percent), "near-links")
        by_node = labels.select(F.col("node").alias("u"), F.col("label").alias("lu"))
        edges = links.join(by_node, "u").join(labels.select(F.col("node").alias("v"), F.col("label").alias("lv")), "v")
        moved = components(edges.select(F.col("lu").alias("a"), F.col("lv").alias("b")))
        to = moved.select(F.col("node").alias("label"), F.col("label").alias("to"))
        last, labels = labels, materialize(labels.join(to, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "near-labels")
        release(found, links, moved, last)
        members, written = met.select("bucket", "node", "n", "band", "salts", "salt"), met  # closed buckets stay closed
    release(full)
    firsts = labels.join(classes.select("node", "first"), "node").groupBy("label").agg(F.min("first").alias("g"))
    of_set = classes.select("set_id", "node", "first").join(labels.join(firsts, "label").select("node", "g"), "node", "left").select("set_id", F.coalesce("g", "first").alias("g"))
    return rows.select("doc_id", "doc_key", "n", "set_id").join(of_set, "set_id", "left").drop("set_id")


def link(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of docs: doc_id, n_shingles, component_id, kept.

    Sets are linked with 100 * intersection >= percent * union. component_id is the smallest id reachable.
    Null or wordless text has an empty set, linked with nothing: its component is its own id. Rows of one
    id with different texts are linked by their own sets and may lie in different components. A null id
    takes part; a component without any id has a null component_id, and its rows are kept. Ties cannot
    occur. Other columns are ignored; an empty table gives an empty table.
    """
    out = _linked(docs, k, percent, id_col, text_col)
    out = out.withColumn("component_id", F.when(F.col("g").isNull(), F.col("doc_id")).otherwise(F.col("g.doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def _with_heads(now: DataFrame, r: int) -> DataFrame:
    """now's rows in buckets whose members are not all connected yet, with one member of the bucket: v, nv, lv."""
    order = F.col("node") if r == 0 else F.xxhash64(F.lit(r), "node")
    head = F.min(F.struct(order.alias("o"), "node", "n", "label")).alias("h")
    heads = now.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.max("salts").alias("m"), head).where("x <> y")
    salts = F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("salt")
    heads = heads.select("bucket", salts, F.col("h.node").alias("v"), F.col("h.n").alias("nv"), F.col("h.label").alias("lv"))
    return now.join(heads, ["bucket", "salt"])


def _across(met: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """bucket, ub, vb, node, partners: of members outside a bucket's largest component and members of other
    components, those that the registers do not rule out, by block.

    A bucket's minors and all its members are cut into blocks by number and length; each pair of blocks is one small group of
    rows. A bucket of one block takes part with one row a member.
    """
    counts = met.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("w"), F.max("salts").alias("salts"))
    largest = F.max(F.struct("c", "label", "w")).alias("m")
    main = counts.groupBy("bucket").agg(largest, F.sum("c").alias("all"), F.sum("w").alias("all_w"), F.max("salts").alias("salts"))
    cut = lambda c, w: F.ceil(F.greatest(c / BLOCK, w / BLOCK_SHINGLES)).cast("int")
    salts = F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")
    main = main.select("bucket", salts, F.col("m.label").alias("main"), cut(F.col("all"), F.col("all_w")).alias("vk"), cut(F.col("all") - F.col("m.c"), F.col("all_w") - F.col("m.w")).alias("uk"))
    rows = met.select("bucket", "salt", "band", "node", "n", "label").join(main, ["bucket", "salt"])
    is_main = F.col("label") == F.col("main")
    part = lambda n: F.pmod(F.xxhash64(F.lit(7), "node"), n).cast("int")
    place = lambda u, v, ub, vb: F.struct(u.alias("as_u"), v.alias("as_v"), ub.cast("int").alias("ub"), vb.cast("int").alias("vb"))
    yes, no = F.lit(True), F.lit(False)
    as_u = F.transform(F.sequence(F.lit(0), F.col("vk") - 1), lambda b: place(yes, no, part(F.col("uk")), b))
    as_v = F.transform(F.sequence(F.lit(0), F.col("uk") - 1), lambda b: place(no, yes, b, part(F.col("vk"))))
    many = F.when(is_main, as_v).otherwise(F.concat(as_u, as_v))
    places = F.when((F.col("uk") == 1) & (F.col("vk") == 1), F.array(place(~is_main, yes, F.lit(0), F.lit(0)))).otherwise(many)
    blocks = rows.select("bucket", "band", "node", "n", "label", is_main.alias("is_main"), F.explode(places).alias("p")).select("*", "p.*").drop("p")
    blocks = blocks.join(full.select("node", "regs"), "node").repartition("bucket", "ub", "vb").sortWithinPartitions("bucket", "ub", "vb")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in whole_blocks(batches):
            yield survivors(rows, percent)
        trim()

    return blocks.mapInPandas(run, "bucket long, ub int, vb int, node long, partners array<long>")


BY_BLOCK = ["bucket", "ub", "vb"]


def starts_of(rows: pd.DataFrame) -> list[int]:
    """Where the blocks of sorted rows begin."""
    block = rows[BY_BLOCK].to_numpy()
    return np.flatnonzero(np.concatenate(([True], (block[1:] != block[:-1]).any(1)))).tolist() if len(rows) else []


def whole_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted batches regrouped so that no block is cut."""
    rest: list[pd.DataFrame] = []  # the rows of a block that may go on in the next batch
    for pdf in batches:
        starts = starts_of(pdf)
        if not starts:
            continue
        if rest and (rest[-1][BY_BLOCK].iloc[-1] != pdf[BY_BLOCK].iloc[0]).any():
            yield pd.concat(rest)
            rest = []
        if len(starts) > 1:
            yield pd.concat([*rest, pdf.iloc[: starts[-1]]])
            rest = []
        rest.append(pdf.iloc[starts[-1] :])
    if rest:
        yield pd.concat(rest)


def _confirmed_blocks(partners: DataFrame, full: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs of _across() whose full sets are similar enough. A block is one small group of rows."""
    rows = partners.join(full.select("node", "text"), "node").repartition(*BY_BLOCK).sortWithinPartitions(*BY_BLOCK)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in whole_blocks(batches):
            out: list[tuple[int, int]] = []
            starts = starts_of(part)
            for at, end in zip(starts, [*starts[1:], len(part)], strict=True):
                mine = part.iloc[at:end]
                text = dict(zip(mine["node"].tolist(), mine["text"], strict=True))
                sets: dict[int, np.ndarray] = {}
                for u, vs in zip(mine["node"].tolist(), mine["partners"], strict=True):
                    for v in [] if vs is None else vs.tolist():
                        for x in (u, v):
                            if x not in sets:
                                sets[x] = shingles(text[x], k)
                        if similar(sets[u], sets[v], percent):
                            out.append((u, v))
            yield pd.DataFrame(out, columns=["u", "v"], dtype=np.int64)
        _WORDS.clear()
        trim()

    return rows.mapInPandas(run, "u long, v long")


_GRID = np.linspace(0, 1, 101)


def survivors(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Of some whole blocks (sorted) the members of pairs that are apart, similar in size, not ruled out by their
    registers, and in no earlier bucket together; a pair is named by one of its two members."""
    regs = np.frombuffer(b"".join(map(bytes, rows["regs"])), ">u2").astype(np.uint16).reshape(-1, M)
    node, n, label, band = (rows[c].to_numpy(np.int64) for c in ("node", "n", "label", "band"))
    is_main, as_u, as_v = (rows[c].to_numpy(bool) for c in ("is_main", "as_u", "as_v"))
    starts = starts_of(rows)
    us, vs, held, out = [], [], 0, []

    def compare() -> None:
        u, v = np.concatenate(us), np.concatenate(vs)
        for at in range(0, len(u), PAIRS):
            a, b = u[at : at + PAIRS], v[at : at + PAIRS]
            same = regs[a] == regs[b]
            shared = same.reshape(len(a), BANDS, ROWS).all(2)
            here = shared.any(1) & (shared.argmax(1) == band[a])
            a, b, same = a[here], b[here], same[here]
            less = (regs[a] < regs[b]).sum(1)
            left = ~_ruled_out(n[a], n[b], M - less - same.sum(1), less, percent / 100)
            out.append(np.column_stack([a[left], b[left]]))

    for start, end in zip(starts, [*starts[1:], len(rows)], strict=True):
        iu, iv = start + np.flatnonzero(as_u[start:end]), start + np.flatnonzero(as_v[start:end])
        step = max(1, PAIRS // max(1, len(iv)))
        for at in range(0, len(iu), step):
            a, b = np.repeat(iu[at : at + step], len(iv)), np.tile(iv, len(iu[at : at + step]))
            fit = (label[a] != label[b]) & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])) & (is_main[b] | (node[a] < node[b]))
            us.append(a[fit])
            vs.append(b[fit])
            held += int(fit.sum())
            if held >= PAIRS:
                compare()
                us, vs, held = [], [], 0
    if held:
        compare()
    found = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
    found = found[np.argsort(found[:, 0], kind="stable")]
    who, first = np.unique(found[:, 0], return_index=True)
    others = np.setdiff1d(found[:, 1], who)  # rows that are only named
    partners = np.full(len(who) + len(others), None, object)
    for i, b in enumerate(np.split(found[:, 1], first[1:]) if len(who) else []):
        partners[i] = node[b]
    return rows[[*BY_BLOCK, "node"]].iloc[np.concatenate([who, others])].assign(partners=partners)


def _ruled_out(na: np.ndarray, nb: np.ndarray, more: np.ndarray, less: np.ndarray, threshold: float) -> np.ndarray:
    """estimate() for many pairs, on a coarser grid."""
    u, v = (na / (na + nb))[:, None], (nb / (na + nb))[:, None]
    ll = _log_likelihood(_GRID[None, :], u, v, more[:, None], less[:, None])
    ll = np.where(_GRID[None, :] <= np.minimum(u / v, v / u) + 1e-9, ll, -np.inf)
    return ll.max(1) - ll[:, _GRID >= threshold - 0.011].max(1) > RULED_OUT


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' rows, all columns: of each component of link() the document with the smallest id, and of one
    without any id the document first by the digest of its text. Rows of one id and text are one document,
    rows without id and of one text likewise; they stay or go together. Empty sets stay."""
    linked = _linked(docs, k, percent, id_col, text_col)
    g = F.col("g.doc_id")
    stays = F.when(F.col("g").isNull(), True).when(g.isNull(), F.col("doc_key") == F.col("g.doc_key")).otherwise(F.col("doc_id").eqNullSafe(g))
    gone = unused(docs, "__near_drop")
    drop = linked.where(~stays).select(F.col("doc_key").alias(gone)).distinct()
    key = document_key(docs[id_col].cast("long"), docs[text_col])
    return docs.join(drop, key == F.col(gone), "left_anti")
