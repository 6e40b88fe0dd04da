"""SpotSigs fingerprints, with DataFrame operations only.

A spot signature is a common word (the anchor) and the next CHAIN content words after it, within REACH
words; a text's fingerprint is its set of hashed signatures. Likeness is the Jaccard similarity of two
sets. near_pairs() compares many: sets are partitioned by their length so that each meets only
partitions of compatible length, candidates share one of their rarest signatures (a frequent one is dealt
out by a salt), and pairs whose lengths or remaining signatures cannot reach the threshold are pruned before
the sets are compared. edited_likeness() compares given pairs; whether such a pair is near goes through
the same partitions and bound.

neighbours() finds each document's successor by id without a global sort in one task: ids are cut into
ranges at approximate quantiles, each range also gets a copy of the first document of the next one, and
a window inside a range does the rest. Text is shuffled once. The cuts are made in two steps, COARSE
parts by literals of the plan and the ranges inside a part by a table, so their number follows the corpus:
a range has some RANGE_DOCS documents, in corpora of more than MANY ranges some LARGE_DOCS.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.frequency import dense
from .common import materialize

#: Common words of the four languages that serve as anchors.
ANCHORS = (
    "the of and to a in is that it for was on with as be by this are at from "
    "de la le et les des en un du une que pour est par qui dans avec sur pas au "
    "der die und den von zu das mit sich auf für ist im nicht dem ein eine als "
    "el y los se del las por con no su una para es al lo"
).split()
CHAIN, REACH = 2, 8
RANGE_DOCS, MANY, LARGE_DOCS, COARSE = 512, 16_384, 65_536, 128
BROADCAST_RANGES = 1 << 20  # ranges whose first ids (24 bytes each) may be broadcast
THRESHOLD = 0.8
HOT = 1024  # sets with a signature that one task joins, about


def signatures(text: Column) -> Column:
    """The sorted set of a text's hashed spot signatures, as array<int>.

    Words are runs of letters and digits, lower-cased. A text without a full chain after any anchor has
    the hashes of its pairs of neighbouring words instead; one of a single word has that word's; one
    without words has none.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))

    def chains(w: Column) -> Column:
        def chain(x: Column, i: Column) -> Column:
            after = F.slice(F.filter(F.slice(w, i + 2, REACH), lambda y: ~y.isin(ANCHORS)), 1, CHAIN)
            return F.when(x.isin(ANCHORS) & (F.size(after) == CHAIN), F.hash(x, after))

        return F.filter(F.transform(w, chain), lambda h: h.isNotNull())

    def all_of(w: Column) -> Column:
        spots = chains(w)
        pairs = F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.hash(F.element_at(w, i), F.element_at(w, i + 1)))
        rest = F.when(F.size(w) >= 2, pairs).otherwise(F.transform(w, lambda x: F.hash(x)))
        return F.transform(F.array(spots), lambda s: F.when(F.size(s) > 0, s).otherwise(rest))[0]

    return F.sort_array(F.array_distinct(F.transform(F.array(words), all_of)[0]))


def fingerprint(sigs: Column) -> Column:
    """The set as text: eight hexadecimal digits a signature."""
    return F.array_join(F.transform(sigs, lambda h: F.lpad(F.hex(F.pmod(h.cast("long"), F.lit(1 << 32))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity; 1 for two empty sets."""
    both = F.size(F.array_intersect(a, b))
    any_ = F.size(a) + F.size(b) - both
    return F.when(any_ == 0, 1.0).otherwise(both / any_).cast("double")


def length_class(sigs: Column, threshold: float = THRESHOLD) -> Column:
    """Sets whose lengths differ by less than the threshold fall into the same or neighbouring classes."""
    return F.floor(F.log(F.greatest(F.size(sigs), F.lit(1))) / F.log(F.lit(1 / threshold))).cast("int")


def _below(doc_id: Column, bounds: Column) -> Column:
    """How many of the sorted bounds are at most doc_id; 0 for null."""
    return F.when(doc_id.isNull(), 0).otherwise(F.size(F.filter(bounds, lambda b: b <= doc_id)))


def _ranged(docs: DataFrame) -> tuple[DataFrame, int]:
    """docs with range, which follows the order of doc_id (nulls in the first), and about how many there are."""
    n = docs.count()
    k = max(1, min(n // RANGE_DOCS, MANY), n // LARGE_DOCS)
    parts = min(COARSE, k)
    fine = -(-k // parts)
    cuts = docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10_000)).first()[0] if parts > 1 else None
    part = _below(F.col("doc_id"), F.array(*map(F.lit, sorted(set(cuts or [])))).cast("array<bigint>"))
    docs = docs.withColumn("part", part)
    if fine == 1:
        return docs.withColumn("range", F.col("part").cast("long")).drop("part"), k
    inner = docs.groupBy("part").agg(F.sort_array(F.array_distinct(F.percentile_approx("doc_id", [i / fine for i in range(1, fine)], 10_000))).alias("cuts"))
    inner = materialize(inner, "spot-cuts")  # at most COARSE rows
    docs = docs.join(F.broadcast(inner) if k <= BROADCAST_RANGES else inner, "part")
    inside = F.coalesce(_below(F.col("doc_id"), F.col("cuts")), F.lit(0))
    return docs.withColumn("range", F.col("part").cast("long") * (fine + 1) + inside).drop("part", "cuts"), k


def neighbours(docs: DataFrame, derive: dict | None = None) -> DataFrame:
    """docs: doc_id, text. Adds next_text and, for each name and function of the text in derive, name and
    next_name, of the next row by (doc_id, text); null ids come first; after the last row comes the first.
    """
    derive = derive or {}
    ranged, k = _ranged(docs)
    found = ranged.groupBy("range").agg(F.min("doc_id").alias("first"), F.max(F.col("doc_id").isNull()).alias("null"))
    found = found.select("range", F.when(~F.col("null"), F.col("first")).alias("first"))
    found = materialize(dense(found, "range"), "spot-ranges")  # a row a range
    n = found.count()
    own_rn = found.select("range", F.col("rn").alias("to"))
    lends = found.select("first", (F.pmod(F.col("rn") - 2, F.lit(max(1, n))) + 1).alias("to"), (F.col("rn") == 1).cast("int").alias("wrap"))
    to = lends.join(own_rn, "to").select("range", "first", "wrap")  # the first range's goes to the last
    to = F.broadcast(to) if n <= BROADCAST_RANGES else to
    own = ranged.select("range", "doc_id", "text", F.lit(0).alias("ghost"))
    lent = docs.join(to, docs["doc_id"].eqNullSafe(to["first"])).select("range", "doc_id", "text", F.lit(1).alias("ghost"))
    rows = own.unionByName(lent).repartition("range")
    rows = rows.withColumns({c: f(F.col("text")) for c, f in derive.items()})
    order = Window.partitionBy("range").orderBy("ghost", F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = rows.withColumns({f"next_{c}": F.lead(c).over(order) for c in ("text", *derive)})
    return rows.where("ghost = 0").drop("ghost", "range")


def may_be_near(a: Column, b: Column, threshold: float = THRESHOLD) -> Column:
    """Whether sets of these lengths can be near: the same or neighbouring partitions, and the bound."""
    na, nb = F.size(a), F.size(b)
    return (F.abs(length_class(a, threshold) - length_class(b, threshold)) <= 1) & (F.least(na, nb) >= threshold * F.greatest(na, nb) - 1e-9)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of docs: doc_id, text, signatures."""
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    return own.withColumn("signatures", signatures(F.col("text")))


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's fingerprint against that of the text with its last half replaced by the start of the
    next document, and against the next document's.

    Null text is empty. Null ids come first in the order of documents, ties are ordered by text, and
    repeated rows follow each other. A lone document is its own next. Other columns are ignored. An
    empty table gives an empty table.
    """
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    rows = neighbours(own, {"sigs": signatures}).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half))
    rows = rows.withColumn("edited", edited).withColumn("edited_sigs", signatures(F.col("edited")))
    near = lambda b, likeness: F.when(may_be_near(F.col("sigs"), F.col(b)), F.col(likeness) >= THRESHOLD).otherwise(False)
    out = rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("sigs")).alias("fingerprint"),
        fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
        length_class(F.col("sigs")).alias("length_class"),
        "sigs",
        "edited_sigs",
        "next_sigs",
    )
    return out.withColumns({"edited_is_near": near("edited_sigs", "near_edited"), "next_is_near": near("next_sigs", "near_next")}).drop("sigs", "edited_sigs", "next_sigs")


def near_pairs(prints: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """prints: doc_id, signatures. Gives members (doc_id, class_id: the smallest id of the same set) and
    pairs of classes (a, b, likeness) of at least threshold, each once. Empty sets pair with nothing. Sets are
    told apart by themselves: ids may repeat with other sets or be null (then so is the class's id, if all are).

    Exact: two such sets share a signature among the first |A| - ceil(t |A|) + 1 of either in any common
    order; rarest first keeps common signatures out of the join. At the first signature that they share, what
    is left of either set must suffice for the overlap that the threshold asks for.
    """
    prints = prints.select("doc_id", "signatures")
    by_set = prints.groupBy(F.sha2(fingerprint(F.col("signatures")), 256).alias("key")).agg(F.min("doc_id").alias("class_id"), F.first("signatures").alias("s"))
    by_set = materialize(by_set.withColumn("node", F.monotonically_increasing_id()), "spot-sets")
    members = prints.withColumn("key", F.sha2(fingerprint(F.col("signatures")), 256)).join(by_set.select("key", "class_id"), "key").select("doc_id", "class_id")
    sets = by_set.where(F.size("s") > 0).select("node", "class_id", "s", F.size("s").alias("n"), length_class(F.col("s"), threshold).alias("part"))
    each = sets.select("node", "n", "part", F.explode("s").alias("sig"))
    df = each.groupBy("sig").agg(F.count(F.lit(1)).alias("df"))
    rare = each.join(df, "sig").withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy("df", "sig")))
    rare = rare.where(F.col("rank") <= F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1).where("df > 1")
    rare = rare.withColumn("salts", F.ceil(F.col("df") / HOT).cast("int"))
    parts = F.explode(F.array(F.col("part"), F.col("part") + 1, F.col("part") - 1)).alias("part")
    a = rare.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("rank").alias("ra"), "sig", "salts", parts)
    a = a.select("a", "na", "ra", "sig", "part", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    b = rare.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("rank").alias("rb"), "sig", "part", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"))
    close = (F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9) & (F.col("a") < F.col("b"))
    enough = 1 + F.least(F.col("na") - F.col("ra"), F.col("nb") - F.col("rb")) >= threshold / (1 + threshold) * (F.col("na") + F.col("nb")) - 1e-9
    found = a.join(b, ["sig", "part", "salt"]).where(close & enough).select("a", "b").distinct()
    left = sets.select(F.col("node").alias("a"), F.col("class_id").alias("ca"), F.col("s").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("class_id").alias("cb"), F.col("s").alias("sb"))
    pairs = found.join(left, "a").join(right, "b").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"), likeness(F.col("sa"), F.col("sb")).alias("likeness"))
    return members, pairs.where(F.col("likeness") >= threshold)
