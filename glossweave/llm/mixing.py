"""Mixing sources to target weights, with DataFrame operations only.

Sources get targets by water-filling over their weights. The documents of a source are dealt by a hash
into blocks, which a second hash permutes; a source is drawn as whole passes over its blocks plus the
first permuted blocks of one more pass. Where that pass ends, the documents about its end, in permuted order,
are a pool of at most POOL, of which those are taken that come nearest to the target together: every subset
of a few is tried, of more the longest first from each place on (so a source of up to POOL documents is
chosen as a whole, and a document too long for the rest never pushes the others out). That gives an exact
quota of blocks for each source. A splitting tree deals the quotas out: the root holds the vector of quotas,
each node gives half of its blocks to either child, its left vector drawn from the multivariate
hypergeometric law (conditional hypergeometric draws, inverted from their exact probabilities), until
the leaves are output shards with exact quotas. Every shard then takes the next blocks of each
source's permuted sequence, so shards are disjoint, and is shuffled locally.

Shards hold some SHARD_WORDS words and SHARD_BLOCKS blocks each, so their number and that of the blocks
follow the mix and no task grows with it. Only (source, block) sums are shuffled, and joins are on (source,
block), so a source with a third of all rows is spread over its blocks; places in the permuted order are
counted by segments of some SEGMENT blocks. Tables of sources are never broadcast by hint: Spark decides
by measured sizes. The leaves are written once, before the blocks meet them.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.frequency import dense
from .common import SPACE, materialize, release

#: Fixed values of the contract: repeating weights and the most a source or document may be repeated.
WEIGHTS = (5, 2, 1)
MOST = 3
SHARD_WORDS, SHARD_BLOCKS = 1 << 22, 64
LEAST_LEVELS = 3  # eight shards at least
TREE_STEP = 4  # levels of the tree between two written tables
SEGMENT = 1024
POOL, BACK = 256, 64  # documents to choose from at the end of a broken pass, and how many of them lie before it
EXACT = 12  # of so many, every subset is tried
GROUPS = 1 << 14  # partitions of an exchange at most
TREE_SOURCES = 512  # sources that one tree deals out
SEED = 20_240


def n_words(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in the text; 0 for null."""
    inner = F.btrim(text, F.lit(SPACE))
    return F.when(F.length(inner) > 0, F.size(F.split(inner, "[\\x20\\x09-\\x0D]+"))).otherwise(0).cast("long")


def _bind(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.transform(F.array(value), use)[0]


def _log_factorial(n: Column) -> Column:
    """By Stirling's series six places up; good to about 1e-9."""
    z = n.cast("double") + 1
    y = z + 6
    series = (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y)
    return series - F.log(reduce(lambda a, b: a * b, (z + k for k in range(6))))


def _uniform(*cols: Column) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 52)).cast("double") / float(1 << 52)


def hypergeometric(total: Column, good: Column, draws: Column, u: Column) -> Column:
    """How many of draws from total are good, for a uniform u: the inverse of the distribution function,
    summed over nine standard deviations about the mean (all of the support, if that is narrower)."""

    def solve(p: Column) -> Column:
        n, k, m = p["n"], p["k"], p["m"]
        mean = m * k / F.greatest(n, F.lit(1))
        sd = F.sqrt(mean * (1 - k / F.greatest(n, F.lit(1))) * (n - m) / F.greatest(n - 1, F.lit(1)))
        low = F.greatest(F.lit(0), m - (n - k), F.floor(mean - 9 * sd).cast("long") - 1)
        high = F.least(m, k, F.ceil(mean + 9 * sd).cast("long") + 1)

        def log_p(x: Column) -> Column:
            return -(_log_factorial(x) + _log_factorial(k - x) + _log_factorial(m - x) + _log_factorial(n - k - m + x))

        def pick(w: Column) -> Column:
            top = F.array_max(F.transform(w, lambda x: x["lp"]))
            odds = F.transform(w, lambda x: F.struct(x["x"].alias("x"), F.exp(x["lp"] - top).alias("o")))
            whole = F.aggregate(odds, F.lit(0.0), lambda a, x: a + x["o"])
            start = F.struct(F.lit(0.0).alias("sum"), w[0]["x"].alias("x"))
            found = F.aggregate(odds, start, lambda a, x: F.struct((a["sum"] + x["o"]).alias("sum"), F.when(a["sum"] <= p["u"] * whole, x["x"]).otherwise(a["x"]).alias("x")))
            return found["x"]

        return F.when(low >= high, low).otherwise(_bind(F.transform(F.sequence(low, high), lambda x: F.struct(x.alias("x"), log_p(x).alias("lp"))), pick))

    return _bind(F.struct(total.cast("long").alias("n"), good.cast("long").alias("k"), draws.cast("long").alias("m"), u.alias("u")), solve)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sizes: source_size and a key of each source, __m_source, in the order of the sources. Adds rank, weight,
    target.

    The level of the water is raised until no more sources meet their cap (most times their size): each
    round is one aggregate over the sources, whatever their number.
    """
    w = dense(sizes, "__m_source").withColumnRenamed("rn", "rank")
    w = w.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("rank") - 1, F.lit(len(weights))).cast("int") + 1).cast("long"))
    w = materialize(w.withColumn("cap", most * F.col("source_size")), "mix-caps")
    total, free = w.agg(F.sum("source_size"), F.sum("weight")).first()
    at_cap, share = 0, lambda rest, free: F.lit(float(rest)) * F.col("weight") / F.lit(float(free))
    while free:
        full = F.col("cap") <= share(total - at_cap, free)
        caps, left = w.agg(F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight")))).first()
        if (caps or 0, left or 0) == (at_cap, free):
            break
        at_cap, free = caps or 0, left or 0
    target = F.least(F.col("cap").cast("double"), share((total or 0) - at_cap, free)) if free else F.col("cap").cast("double")
    return w.withColumn("target", target).drop("cap")


def _deal(seed: int):
    """One conditional draw: the state keeps the blocks not yet passed and those the child still needs."""

    def take(a: Column, x: Column) -> Column:
        u = _uniform(F.lit(seed + 1), F.col("level"), F.col("tree"), F.col("node"), F.size(a["out"]))
        return _bind(hypergeometric(a["pop"], x, a["need"], u), lambda n: F.struct((a["pop"] - x).alias("pop"), (a["need"] - n).alias("need"), F.array_append(a["out"], n).alias("out")))

    return take


def shard_quotas(quotas: DataFrame, levels: int, seed: int) -> DataFrame:
    """quotas: rank, quota (blocks). Gives rank, shard, n: the splitting tree's leaves."""
    tree = F.floor((F.col("rank") - 1) / TREE_SOURCES)
    nodes = quotas.groupBy(tree.alias("tree")).agg(F.array_sort(F.collect_list(F.struct("rank", "quota"))).alias("all"))  # at most TREE_SOURCES
    nodes = nodes.select("tree", F.lit(0).cast("long").alias("node"), F.transform("all", lambda x: x["rank"]).alias("ranks"), F.transform("all", lambda x: x["quota"]).alias("q"))
    total = F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x)
    odd = F.pmod(F.xxhash64(F.lit(seed), "level", "tree", "node"), F.lit(2))
    start = F.struct(total.alias("pop"), F.floor((total + odd) / 2).cast("long").alias("need"), F.array().cast("array<bigint>").alias("out"))
    left = F.aggregate("q", start, _deal(seed), lambda a: a["out"])  # the same expression on every level
    pair = F.array(
        F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("q")),
        F.struct((F.col("node") * 2 + 1).alias("node"), F.zip_with("q", "left", lambda a, b: a - b).alias("q")),
    )
    for level in range(levels):
        if level and level % TREE_STEP == 0:
            nodes = materialize(nodes, "mix-nodes").repartition("tree", "node")
        nodes = nodes.withColumn("level", F.lit(level)).withColumn("left", left).select("tree", "ranks", F.explode(pair).alias("p")).select("tree", "ranks", "p.node", "p.q")
    leaves = nodes.select(F.col("node").alias("shard"), F.explode(F.arrays_zip("ranks", "q")).alias("e"))
    return materialize(leaves.select(F.col("e.ranks").alias("rank"), "shard", F.col("e.q").alias("n")).where("n > 0"), "mix-leaves")


def _key(source: Column) -> Column:
    """In the order of sources by code point, null last."""
    return F.when(source.isNull(), F.lit("t")).otherwise(F.concat(F.lit("s"), source))


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    return docs.withColumns(
        {
            "__m_source": _key(docs[source_col].cast("string")),
            "__m_hash": F.xxhash64(F.lit(seed), docs[id_col], docs[text_col]),
            "__m_size": n_words(docs[text_col]),
        }
    )


def _placed(sums: DataFrame, seed: int) -> DataFrame:
    """sums: __m_source, n_blocks, __m_block, size, n (documents). Adds pos, before and ahead: the blocks, the words and
    the documents ahead of a block in the source's permuted order, and held, the source's blocks that hold
    documents. Sums run inside segments of the permuting hash, then over the segments of a source."""
    mixed = F.xxhash64(F.lit(seed + 2), "__m_source", "__m_block")
    segment = F.floor(F.shiftrightunsigned(mixed, 11).cast("double") / float(1 << 53) * F.ceil(F.col("n_blocks") / SEGMENT))
    sums = sums.withColumn("mixed", F.shiftrightunsigned(mixed, 11)).withColumn("segment", segment)
    of = sums.groupBy("__m_source", "segment").agg(F.count(F.lit(1)).alias("pos"), F.sum("size").alias("before"), F.sum("n").alias("ahead"))
    earlier = Window.partitionBy("__m_source").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)  # a row a segment
    held = F.sum("pos").over(Window.partitionBy("__m_source")).alias("held")
    of = of.select("__m_source", "segment", held, *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_0") for c in ("pos", "before", "ahead")))
    order = Window.partitionBy("__m_source", "segment").orderBy("mixed", "__m_block")  # some SEGMENT rows
    own = {"pos": F.row_number().over(order).cast("long") - 1, "before": F.sum("size").over(order) - F.col("size"), "ahead": F.sum("n").over(order) - F.col("n")}
    placed = sums.withColumns(own).join(of, ["__m_source", "segment"])
    return placed.withColumns({c: F.col(c) + F.col(f"{c}_0") for c in own}).drop("segment", "mixed", *(f"{c}_0" for c in own))


def _blocks(keyed: DataFrame, levels: int | None, seed: int, weights: tuple[int, ...], most: int) -> tuple[DataFrame, DataFrame, int]:
    """The sources (with target and n_blocks), their drawn blocks (with draws and, at the end of the
    broken pass, the documents to take in that pass) and the levels of the tree."""
    sized = materialize(keyed.select("__m_source", "__m_hash", "__m_size"), "mix-sizes")
    raw = sized.groupBy("__m_source").agg(F.sum("__m_size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    sources = targets(raw, weights, most)
    words = sources.agg(F.sum("target")).first()[0] or 0.0
    if levels is None:
        levels = max(LEAST_LEVELS, math.ceil(math.log2(max(1.0, words / SHARD_WORDS))))
    block_words = max(1.0, words / ((1 << levels) * SHARD_BLOCKS))
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0).cast("long")
    sources = sources.withColumn("full", full).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("full") * F.col("source_size")))
    sources = sources.withColumn("n_blocks", F.greatest(F.lit(1), F.least(F.col("n_docs"), F.ceil(F.col("source_size") / F.lit(block_words)))).cast("long"))
    sources = materialize(sources.select("__m_source", "rank", "source_size", "target", "full", "rest", "n_blocks"), "mix-sources")
    block = F.pmod(F.col("__m_hash"), F.col("n_blocks"))
    dealt_out = sized.join(sources.select("__m_source", "n_blocks"), "__m_source").withColumn("__m_block", block)
    sums = dealt_out.groupBy("__m_source", "n_blocks", "__m_block").agg(F.sum("__m_size").alias("size"), F.count(F.lit(1)).alias("n"))
    placed = _placed(materialize(sums, "mix-sums"), seed).drop("n_blocks").join(sources.select("__m_source", "rank", "full", "rest"), "__m_source")
    placed = materialize(placed, "mix-placed")
    ends = materialize(_ends(dealt_out, placed), "mix-ends")
    lasts = ends.groupBy("__m_source").agg(F.max("last").alias("last"))
    draws = F.col("full") + F.when(F.col("pos") <= F.col("last"), 1).otherwise(0)
    each_block = placed.join(lasts, "__m_source", "left").withColumn("draws", draws)
    leaves = shard_quotas(each_block.groupBy("rank").agg(F.sum("draws").alias("quota")), levels, seed)
    runs = leaves.withColumn("end", F.sum("n").over(Window.partitionBy("rank").orderBy("shard")))  # a row a shard
    dealt = runs.select("rank", F.col("shard").cast("int").alias("shard"), F.explode(F.sequence(F.col("end") - F.col("n"), F.col("end") - 1)).alias("draw"))
    each = each_block.where("draws > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("draws") - 1)).alias("pass"))
    each = each.withColumn("draw", F.col("pass") * F.col("held") + F.col("pos")).join(dealt, ["rank", "draw"])
    drawn = each.groupBy("__m_source", "__m_block").agg(
        F.array_sort(F.collect_list(F.struct(F.col("pass").cast("int").alias("pass"), "shard"))).alias("__m_draws"),  # at most MOST + 1
        F.max("full").alias("__m_full"),
    )
    blocks = materialize(drawn.join(ends.drop("last"), ["__m_source", "__m_block"], "left"), "mix-drawn")
    release(sized, placed, ends, leaves)
    return sources, blocks, levels


def nearest(pool: Column, gap: Column) -> Column:
    """Of pool, an array of (s, h) with the largest s first, the h of those whose s together come near gap: of up to
    EXACT the nearest subset; of more, what fits is taken in turn from each place of the array on, or what had been taken
    when one that did not fit came nearest from above, with it; the best of these ways counts."""
    n = F.size(pool)

    def subset(mask: Column) -> Column:
        return F.filter(pool, lambda x, i: F.call_function("getbit", mask, i) == 1)

    def off(mask: Column) -> Column:
        return F.abs(gap - F.aggregate(subset(mask), F.lit(0.0), lambda a, x: a + x["s"]))

    masks = F.sequence(F.lit(0).cast("long"), F.call_function("shiftleft", F.lit(1).cast("long"), n) - 1)
    exact = F.transform(subset(F.array_min(F.transform(masks, lambda m: F.struct(off(m).alias("e"), m.alias("m"))))["m"]), lambda x: x["h"])

    def state(left: Column, ids: Column, over: Column, at: Column, h: Column) -> Column:
        return F.struct(left.alias("left"), ids.alias("ids"), over.alias("over"), at.alias("at"), h.alias("h"))

    def fitted(first: Column, keep) -> Column:
        """From place first on: what is taken (keep: an array of one h, or none), what the gap then lacks, and the
        least excess (over) of a document that did not fit, with how many were taken before it."""
        start = state(gap, F.array().cast("array<bigint>"), F.lit(None).cast("double"), F.lit(0), F.lit(None).cast("bigint"))
        takes = lambda a, x: state(a["left"] - x["s"], F.concat(a["ids"], keep(x)), a["over"], a["at"], a["h"])
        nearer = lambda a, x: F.coalesce(x["s"] - a["left"] < a["over"], F.lit(True))
        passes = lambda a, x: F.when(nearer(a, x), state(a["left"], a["ids"], x["s"] - a["left"], F.size(a["ids"]), x["h"])).otherwise(a)
        return F.aggregate(F.slice(pool, first + 1, n), start, lambda a, x: F.when(x["s"] <= a["left"], takes(a, x)).otherwise(passes(a, x)))

    def error(first: Column) -> Column:
        return _bind(fitted(first, lambda x: F.array().cast("array<bigint>")), lambda a: F.struct(F.least(a["left"], a["over"]).alias("e"), first.alias("first")))

    def taken(first: Column) -> Column:
        return _bind(fitted(first, lambda x: F.array(x["h"])), lambda a: F.when(a["over"] < a["left"], F.array_append(F.slice(a["ids"], F.lit(1), a["at"]), a["h"])).otherwise(a["ids"]))

    greedy = _bind(F.array_min(F.transform(F.sequence(F.lit(0), n - 1), error))["first"], taken)
    return F.when(n == 0, F.array().cast("array<bigint>")).when(n <= EXACT, exact).otherwise(greedy)


def _ends(dealt_out: DataFrame, placed: DataFrame) -> DataFrame:
    """For the blocks about the end of each source's broken pass: documents hashed below __m_upto (all, if it is
    null) and those in __m_extra are taken in it; last is the place of the last block that it draws.

    A source has one such place: the block where the words ahead reach the rest. The blocks that hold the BACK
    documents before it and the POOL after it are few; of their documents, in permuted order, those before the pool
    are taken and those of the pool are chosen by nearest()."""
    at = placed.where("rest > 0 and before <= rest and rest < before + size")
    at = at.select("__m_source", F.col("ahead").alias("end"), (F.col("ahead") + F.col("n")).alias("beyond"))
    near = placed.join(at, "__m_source").where((F.col("ahead") + F.col("n") > F.col("end") - BACK) & (F.col("ahead") < F.col("beyond") + POOL))
    rows = dealt_out.select("__m_source", "__m_block", "__m_hash", "__m_size").join(near.select("__m_source", "__m_block", "pos", "before", "rest"), ["__m_source", "__m_block"])
    rows = rows.groupBy("__m_source", "__m_block", "pos", "before", "rest", "__m_hash").agg(F.sum("__m_size").alias("s"))  # repeated rows go together
    source = Window.partitionBy("__m_source")  # the documents of these blocks
    order = source.orderBy("pos", "__m_hash")
    rows = rows.withColumns({"rn": F.row_number().over(order), "upto": F.min("before").over(source) + F.sum("s").over(order), "first": F.min("pos").over(source), "all": F.count(F.lit(1)).over(source)})
    rows = rows.withColumn("fit", F.sum((F.col("upto") <= F.col("rest")).cast("long")).over(source))
    rows = rows.withColumn("from", F.greatest(F.lit(1), F.least(F.col("fit") + 1 - BACK, F.col("all") - POOL + 1)))
    rows = materialize(rows.withColumn("pooled", (F.col("rn") >= F.col("from")) & (F.col("rn") < F.col("from") + POOL)), "mix-pool")
    pooled = rows.groupBy("__m_source").agg(
        F.sort_array(F.collect_list(F.when(F.col("pooled"), F.struct(F.col("s").alias("s"), F.col("__m_hash").alias("h")))), False).alias("pool"),  # at most POOL
        (F.max("rest") - F.coalesce(F.max(F.when(F.col("rn") < F.col("from"), F.col("upto"))), F.min("before"))).alias("gap"),
    )
    chosen = materialize(pooled.select("__m_source", nearest(F.col("pool"), F.col("gap")).alias("extra")), "mix-chosen")
    rows = rows.join(chosen, "__m_source").withColumn("extra_here", F.col("pooled") & F.array_contains("extra", F.col("__m_hash")))
    takes = (F.col("rn") < F.col("from")) | F.col("extra_here")
    return rows.groupBy("__m_source", "__m_block").agg(
        F.min(F.when(F.col("rn") >= F.col("from"), F.col("__m_hash"))).alias("__m_upto"),
        F.collect_list(F.when(F.col("extra_here"), F.col("__m_hash"))).alias("__m_extra"),  # at most POOL
        F.max(F.when(takes, F.col("pos")).otherwise(F.col("first") - 1)).alias("last"),
    )


def _drawn(keyed: DataFrame, sources: DataFrame, blocks: DataFrame) -> DataFrame:
    """keyed with __m_target, __m_source_size and __m_draws (pass, shard), empty if it is not drawn."""
    own = sources.select("__m_source", F.col("n_blocks").alias("__m_n"), F.col("source_size").alias("__m_source_size"), F.col("target").alias("__m_target"))
    rows = keyed.join(own, "__m_source").withColumn("__m_block", F.pmod(F.col("__m_hash"), F.col("__m_n"))).drop("__m_n")
    rows = rows.join(blocks, ["__m_source", "__m_block"], "left")
    out = F.col("__m_upto").isNotNull() & (F.col("__m_hash") >= F.col("__m_upto")) & ~F.array_contains("__m_extra", F.col("__m_hash"))
    draws = F.coalesce("__m_draws", F.array().cast("array<struct<pass:int,shard:int>>"))
    draws = F.when(out, F.filter(draws, lambda d: d["pass"] < F.col("__m_full"))).otherwise(draws)
    return rows.withColumn("__m_draws", draws).drop("__m_upto", "__m_extra", "__m_full", "__m_block")


def plan(docs: DataFrame, levels: int | None = None, seed: int = SEED, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row a row of docs: doc_id, source, size, source_size, target and draws, an array of (pass,
    shard) with an element for each time that the mix takes it. levels: the depth of the tree, for two to
    that power shards; by the size of the mix if it is None.

    Null text has size 0. Null source is a source of its own, ranked last. Null ids are ids like others.
    Repeated rows (same id and text) and ties of the hash are drawn alike. A source of size 0
    has target 0 and is not drawn. Other columns are ignored. An empty table gives an empty table.
    """
    docs = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), docs[source_col].cast("string").alias("source"))
    keyed = materialize(_keyed(docs, "doc_id", "text", "source", seed).drop("text"), "mix-keys")
    sources, blocks, _ = _blocks(keyed, levels, seed, weights, most)
    rows = _drawn(keyed, sources, blocks)
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.col("__m_size").alias("size"), F.col("__m_source_size").alias("source_size"), F.col("__m_target").alias("target"), F.col("__m_draws").alias("draws"))


def mix(docs: DataFrame, levels: int | None = None, seed: int = SEED, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", in_shards: bool = True) -> DataFrame:
    """The mixed corpus: docs' rows, each as often as it is drawn, with all of docs' columns and, if
    in_shards, one partition a shard (beyond GROUPS shards, one a run of shards, one after the other), each shard
    shuffled inside. Cases as in plan()."""
    row = F.struct(*docs.columns).alias("__m_row")  # so that no column of docs clashes with those on the way
    keyed = docs.select(row, docs[id_col].alias("doc_id"), docs[text_col].alias("text"), docs[source_col].alias("source"))
    keyed = _keyed(keyed, "doc_id", "text", "source", seed).drop("doc_id", "text", "source")
    sources, blocks, levels = _blocks(keyed, levels, seed, weights, most)
    rows = _drawn(keyed, sources, blocks).withColumn("__m_draw", F.explode("__m_draws"))
    if in_shards:
        groups = min(1 << levels, GROUPS)  # both are powers of two
        group = F.shiftright("__m_draw.shard", levels - groups.bit_length() + 1)
        rows = rows.repartitionById(groups, group).sortWithinPartitions("__m_draw.shard", F.xxhash64(F.lit(seed + 3), "__m_draw.shard", "__m_draw.pass", "__m_hash"))
    return rows.select("__m_row.*")
