"""Counting and ranking of distinct texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.tables import materialize


def text_frequency(bag: DataFrame, text: str = "text") -> DataFrame:
    """text_en (stripped, not blank) and count. Partial sums before the one shuffle, so hot texts are cheap."""
    key = T.strip(text).alias("text_en")
    return bag.where(T.non_blank(text)).groupBy(key).agg(F.count(F.lit(1)).alias("count"))


def ranked(freq: DataFrame) -> DataFrame:
    """rn from 1 by falling count, then by code points.

    Distinct keys are sorted by ranges and numbered by the offset of their range: no task sees all rows.
    """
    order = [F.desc("count"), F.asc("text_en")]
    sorted_ = freq.repartitionByRange(*order).sortWithinPartitions(*order)
    return _numbered(sorted_, freq.columns)


def _numbered(sorted_: DataFrame, columns: list[str]) -> DataFrame:
    """rn by partition and place in it. The rows are written once: sorting them again could cut the ranges
    elsewhere."""
    placed = materialize(sorted_.withColumn("__id", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("__id", 33)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    offsets = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    placed = placed.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    rn = F.col("__before") + F.col("__id").bitwiseAND((1 << 33) - 1) + 1
    return placed.select(*columns, rn.cast("long").alias("rn"))


def batches(keys: DataFrame, size: int) -> DataFrame:
    """batch from 0: consecutive runs of size rows by rn."""
    return keys.withColumn("batch", F.floor((F.col("rn") - 1) / size).cast("long"))


def pipeline_batch_size(total: int, steps: int = 20) -> int:
    return max(1, total // steps)


def dense(rows: DataFrame, by: str) -> DataFrame:
    """rn from 1 in the order of a unique column, numbered by ranges as ranked()."""
    sorted_ = rows.repartitionByRange(F.asc(by)).sortWithinPartitions(F.asc(by))
    return _numbered(sorted_, rows.columns)
