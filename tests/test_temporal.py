"""Joins over time, top-k and bags against brute force, with hot keys, ties, nulls and small bounds."""

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from glossweave.operators import multiset, temporal
from glossweave.plans import shop


def key(r):
    return None if r.random() < 0.05 else 0 if r.random() < 0.5 else r.randint(1, 5)


def maybe(r, low, high):
    return None if r.random() < 0.05 else r.randint(low, high)


@pytest.mark.parametrize("hot", [temporal.HOT, 7])
def test_interval_join(spark, hot):
    r = random.Random(1)
    points = [(i, key(r), maybe(r, -500, 1500)) for i in range(900)] + [(901, 0, 10), (901, 0, 10)]
    spans = [(i, key(r), s := maybe(r, -600, 1500), None if s is None else s + r.choice([-3, 0, 1, 2, 5, 64, 1000])) for i in range(150)]
    spans += [spans[0], (500, 0, -(2**40), 2**40)]
    p = spark.createDataFrame(points, "id int, k int, t long")
    i = spark.createDataFrame(spans, "id int, k int, s long, e long")
    met = temporal.interval_join(p, i, "k", "t", "s", "e", hot)
    want = Counter((a[0], b[0]) for a in points for b in spans if a[1] is not None and a[1] == b[1] and None not in (a[2], b[2], b[3]) and b[2] <= a[2] < b[3])
    assert Counter(map(tuple, met.select("p.id", "i.id").collect())) == want and len(want) > 500
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert temporal.interval_join(p, i.limit(0), "k", "t", "s", "e").count() == 0 == temporal.interval_join(p.limit(0), i, "k", "t", "s", "e").count()


@pytest.mark.parametrize("partitions", [1, 13])
def test_asof_join(spark, partitions):
    """A key over several ranges, ranges without right rows, times with many rows on both sides."""
    r = random.Random(2)
    left = [(i, key(r), maybe(r, 0, 300)) for i in range(800)] + [(801, 0, 7)] * 3
    right = [(i, key(r), maybe(r, 0, 300) if i % 2 else maybe(r, 40, 60)) for i in range(300)]
    at = defaultdict(list)
    for row in right:
        if None not in row[1:]:
            at[row[1]].append((row[2], row[0]))
    want = Counter((i, max((x for x in at[k] if x[0] <= t), default=(None, None))[1] if None not in (k, t) else None) for i, k, t in left)
    l, rt = spark.createDataFrame(left, "id int, k int, t long"), spark.createDataFrame([(t, i, k) for i, k, t in right], "t long, id int, k int")
    got = temporal.asof_join(l, rt, "k", "t", "t", partitions)
    assert Counter((x.l.id, x.r and x.r.id) for x in got.collect()) == want
    assert len({x for _, x in want}) > 50
    assert temporal.asof_join(l.limit(0), rt, "k", "t", "t").count() == 0
    assert Counter(x.r for x in temporal.asof_join(l, rt.limit(0), "k", "t", "t").collect()) == {None: len(left)}


def test_asof_join_query_with_sales_of_one_time(spark, tmp_path):
    """The largest sale of a time may have no total: its number is given, with the total of the largest that has one."""
    at = lambda n: datetime(2024, 1, 1) + timedelta(seconds=n)
    sales = [(1, 7, 10.0, at(5)), (2, 7, 20.0, at(5)), (3, 7, None, at(5)), (4, 7, None, at(9)), (5, 8, 50.0, at(5)), (6, 8, 60.0, at(5)), (7, None, 70.0, at(0)), (8, 7, 80.0, None)]
    clicks = [(1, 7, at(4)), (2, 7, at(5)), (3, 7, at(9)), (4, 8, at(6)), (5, None, at(6)), (6, 7, None), (2, 7, at(5))]
    spark.createDataFrame(sales, "sale_id long, client_id long, total double, sold_at timestamp_ntz").write.parquet(f"{tmp_path}/sales.parquet")
    spark.createDataFrame(clicks, "click_id long, client_id long, ts timestamp_ntz").withColumn("arrived_at", F.col("ts")).write.parquet(f"{tmp_path}/clicks.parquet")
    got = Counter((x.click_id, x.sale_id, x.total) for x in shop.asof_join(spark, str(tmp_path)).collect())
    assert got == Counter([(1, None, None), (2, 3, 20.0), (3, 4, None), (4, 6, 60.0), (5, None, None), (6, None, None), (2, 3, 20.0)])


def test_top_k(spark):
    r = random.Random(3)
    rows = [(i, key(r), maybe(r, 0, 40)) for i in range(2000)]
    df = spark.createDataFrame(rows, "id int, k int, v int")
    got = temporal.top_k(df, ["k"], [F.desc_nulls_last("v")], 4, 3)
    want = set()
    for k in {k for _, k, _ in rows}:
        order = sorted((-1 if v is None else v for _, k2, v in rows if k2 == k), reverse=True)
        want |= {(i, k, v, 1 + sum(o > (-1 if v is None else v) for o in order)) for i, k2, v in rows if k2 == k and sum(o > (-1 if v is None else v) for o in order) < 4}
    assert set(map(tuple, got.select("id", "k", "v", "rank").collect())) == want
    assert got._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 2


def test_bags(spark):
    r = random.Random(4)
    a, b = ([(r.choice([None, "x", "y", "z"]), r.randint(0, 3)) for _ in range(n)] for n in (60, 45))
    left, right = (spark.createDataFrame(x, "t string, n int") for x in (a, b))
    of = lambda df: Counter(map(tuple, df.collect()))
    assert of(multiset.except_all(left, right, ["t", "n"])) == Counter(a) - Counter(b)
    assert of(multiset.intersect_all(left, right, ["t", "n"])) == Counter(a) & Counter(b)
    assert of(multiset.except_all(left, left, ["t", "n"])) == Counter() == of(multiset.intersect_all(left, right.limit(0), ["t", "n"]))


def test_sketches_of_parts_are_those_of_the_whole(spark):
    rows = spark.range(20_000).selectExpr("id % 7 as part", "id % 3000 as who", "cast((id * 7919) % 20000 as double) as v")
    parts = multiset.merged(multiset.sketches(rows, ["part"], "who", "v").withColumn("all", F.lit(1)), ["all"])
    whole = multiset.sketches(rows.withColumn("all", F.lit(1)), ["all"], "who", "v")
    for df in (parts, whole):
        x = df.select("n", F.hll_sketch_estimate("distinct").alias("d"), *(F.expr(f"kll_sketch_get_quantile_double(quantiles, {q}D)").alias(f"q{i}") for i, q in enumerate((0.1, 0.5, 0.9)))).first()
        assert x.n == 20_000 and abs(x.d - 3000) <= 150
        assert all(abs(x[f"q{i}"] - 20_000 * q) <= 600 for i, q in enumerate((0.1, 0.5, 0.9)))
    estimate = lambda df: df.select(F.hll_sketch_estimate("distinct")).first()[0]
    assert estimate(parts) == estimate(whole)
