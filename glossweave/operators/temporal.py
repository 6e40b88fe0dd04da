"""Joins over time that no equality expresses, as equality joins, windows and prefix sums.

Times are whole numbers (micros() makes them of timestamps). Keys may hold any share of the rows: nothing here
puts a key into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import materialize

HOT = 50_000  # points of a bin that one task meets


def micros(at: str | Column) -> Column:
    """Microseconds since 1970 of a timestamp without a zone, whatever the session's zone."""
    at = F.col(at) if isinstance(at, str) else at
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), at.cast("timestamp_ntz"))


def interval_join(points: DataFrame, intervals: DataFrame, key: str, at: str, start: str, end: str, hot: int = HOT) -> DataFrame:
    """p, i: the rows of points and intervals as structs, for each point in each interval of its key (start <= at < end).

    An interval belongs to the level whose bins are at least as long as it is, so that it lies in two bins at most, and
    long ones are not cut into many. A point is looked up in its bin at every level that has intervals. A bin
    with more than hot points is split by a hash of the point, and its intervals go to every part: how many is
    counted first. Null keys and times meet nothing, nor do intervals that end before they begin. Repeated
    rows are met each.
    """
    own = intervals.select(F.struct("*").alias("i"), F.col(key).alias("k"), F.col(start).alias("s"), F.col(end).alias("e")).where("k is not null and s < e")
    own = own.withColumn("level", F.ceil(F.log2((F.col("e") - F.col("s")).cast("double"))).cast("int"))
    width = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("level"))
    first, last = F.floor(F.col("s") / width), F.floor((F.col("e") - 1) / width)
    own = materialize(own.select("i", "k", "s", "e", "level", F.explode(F.sequence(first, last)).alias("bin")), "interval-bins")
    levels = sorted(r["level"] for r in own.select("level").distinct().collect())  # at most 64
    asked = points.select(F.struct("*").alias("p"), F.col(key).alias("k"), F.col(at).alias("t")).where("k is not null and t is not null")
    level = F.explode(F.array(*map(F.lit, levels)).cast("array<int>")).alias("level")
    asked = asked.select("p", "k", "t", level).withColumn("bin", F.floor(F.col("t") / width))
    by = ["k", "level", "bin"]
    dense = asked.groupBy(*by).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > hot).select(*by, F.ceil(F.col("c") / hot).cast("int").alias("parts"))
    dense = materialize(dense, "interval-dense")
    part = F.pmod(F.xxhash64("p"), F.coalesce("parts", F.lit(1))).cast("int")
    asked = asked.join(dense, by, "left").withColumn("part", part).drop("parts")
    parts = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part")
    own = own.join(dense, by, "left").select("i", "s", "e", *by, parts)
    met = asked.join(own, [*by, "part"]).where((F.col("s") <= F.col("t")) & (F.col("t") < F.col("e")))
    return met.select("p", "i")


def asof_join(left: DataFrame, right: DataFrame, key: str, at: str, right_at: str, partitions: int | None = None) -> DataFrame:
    """l, r: every row of left as a struct, with the last row of right of its key up to its time (null without one).

    Both sides are united and sorted by ranges of (key, time), so a key may span many tasks. Inside a range the last
    right row so far is a scan; what a range inherits of a key that began before it is the last right row of
    the ranges before, taken from a table of a row a range and key. Of right rows of one time the largest struct
    counts. Null keys and times on the left have no partner, those on the right are none.
    """
    n = partitions or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    l, r = F.struct(*left.columns), F.struct(*right.columns)
    mine = left.select(F.col(key).alias("k"), F.col(at).alias("t"), l.alias("l"), F.lit(None).cast(right.select(r.alias("r")).schema["r"].dataType).alias("r"))
    theirs = right.select(F.col(key).alias("k"), F.col(right_at).alias("t"), F.lit(None).cast(mine.schema["l"].dataType).alias("l"), r.alias("r"))
    can = F.col("k").isNotNull() & F.col("t").isNotNull()
    both = mine.where(can).unionByName(theirs.where(can)).withColumn("side", F.col("l").isNotNull().cast("int"))
    both = both.withColumn("tie", F.xxhash64("l"))  # many rows of one time may be cut into several ranges
    order = ["k", "t", "side", "r", "tie"]
    ranged = both.repartitionByRange(n, *order).withColumn("range", F.spark_partition_id())
    ranged = materialize(ranged, "asof-ranges")  # ranges are fixed from here on
    so_far = Window.partitionBy("range", "k").orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = ranged.where("side = 0").groupBy("k", "range").agg(F.max(F.struct("t", "r")).alias("last"))
    spans = ranged.groupBy("k", "range").agg(F.max("side").alias("side")).join(ends, ["k", "range"], "left")
    earlier = Window.partitionBy("k").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    inherits = spans.withColumn("carry", F.last("last", ignorenulls=True).over(earlier)).select("k", "range", F.col("carry.r").alias("carry"))
    scanned = ranged.withColumn("seen", F.last("r", ignorenulls=True).over(so_far)).where("side = 1")
    found = scanned.join(inherits, ["k", "range"]).select("l", F.coalesce("seen", "carry").alias("r"))
    return found.unionByName(mine.where(~can).select("l", "r"))


def top_k(rows: DataFrame, by: list[str], order: list[Column], k: int, salts: int = 32) -> DataFrame:
    """rows with rank up to k in their group, ties included (so a group may give more). Every task keeps what may be among
    the first k before anything is shuffled; groups are ranked in parts, and the parts' firsts against each
    other, so a group's rows never meet in one task. Null group keys are a group."""
    part = F.pmod(F.xxhash64(F.struct("*")), F.lit(salts)).alias("__part")
    ranked = lambda df, w: df.withColumn("rank", F.rank().over(w.orderBy(*order))).where(F.col("rank") <= k)
    some = ranked(rows.select("*", part), Window.partitionBy(*by, "__part")).drop("rank", "__part")
    return ranked(some, Window.partitionBy(*by))

