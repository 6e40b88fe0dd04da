"""Differences of bags, totals over sets of columns, and mergeable sketches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K = 12  # of the distinct sketch: a standard error of about 1.04 / sqrt(2 ** LG_K)


def difference(before: DataFrame, after: DataFrame, by: list[str]) -> DataFrame:
    """by, before, after: how often each row stands in either bag, by signed counts in one exchange. Of a revision, rows
    with before = 0 were added, with after = 0 removed. Nulls equal nulls."""
    one = lambda df, b, a: df.select(*by, F.lit(b).alias("b"), F.lit(a).alias("a"))
    both = one(before, 1, 0).unionByName(one(after, 0, 1))
    return both.groupBy(*by).agg(F.sum("b").alias("before"), F.sum("a").alias("after"))


def repeated(rows: DataFrame, times: Column, by: list[str]) -> DataFrame:
    """by as often as times says."""
    return rows.where(times > 0).select(*by, F.explode(F.sequence(F.lit(1), times.cast("int")))).select(*by)


def except_all(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Rows of left, each as often as it stands there more than in right."""
    return repeated(difference(left, right, by), F.col("before") - F.col("after"), by)


def intersect_all(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Rows of both, each as often as in the one that has it less often."""
    return repeated(difference(left, right, by), F.least("before", "after"), by)


def totals(rows: DataFrame, by: list[str], sets: list[list[str]]) -> DataFrame:
    """by, grouping (a bit a column, 1 where it is summed over) and count for every set of columns.

    Rows are counted by all columns first, so that only distinct combinations are expanded, and hot ones are one row
    each; the expanded counts are summed in a second exchange."""
    counted = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    of = counted.groupingSets([[F.col(c) for c in s] for s in sets], *map(F.col, by))
    return of.agg(F.grouping_id().cast("int").alias("grouping"), F.sum("n").alias("count"))


def rollup_sets(by: list[str]) -> list[list[str]]:
    return [by[:n] for n in range(len(by), -1, -1)]


def cube_sets(by: list[str]) -> list[list[str]]:
    return [[c for i, c in enumerate(by) if mask >> i & 1] for mask in range((1 << len(by)) - 1, -1, -1)]


def sketches(rows: DataFrame, by: list[str], distinct: str, value: str) -> DataFrame:
    """by, n, distinct and quantiles: a sketch of the distinct values of one column and of the quantiles of another (a
    double) for every group, to be kept and merged later. Nulls are in neither."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(distinct, LG_K).alias("distinct"), F.kll_sketch_agg_double(value).alias("quantiles"))


def merged(kept: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of coarser groups from those of finer ones."""
    return kept.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_double("quantiles").alias("quantiles"))
