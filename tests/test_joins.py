"""As-of and interval joins against loops over all rows, and against each other's edge cases."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from candlewick.operators import joins


@pytest.fixture(scope="module")
def sides(spark):
    r = random.Random(5)
    left = [(i, r.choice(["a", "b", "c", None]), r.choice([None, *range(0, 60)])) for i in range(160)]
    right = [(r.choice(["a", "a", "b", None]), r.choice([None, *range(-5, 60, 3)]), i) for i in range(70)]
    return left, right, spark.createDataFrame(left, "id int, k string, t long"), spark.createDataFrame(right, "k string, t long, v int")


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize(("tolerance", "how", "slices"), [(None, "left", 3), (4, "inner", 1), (4, "left", 7)])
def test_asof(sides, strict, tolerance, how, slices):
    left, right, a, b = sides
    want = []
    for i, k, t in left:
        before = [(rt, v) for rk, rt, v in right if None not in (k, t, rk, rt) and rk == k and (rt < t if strict else rt <= t)]
        hit = max(before, default=None)
        if hit and tolerance is not None and t - hit[0] > tolerance:
            hit = None
        if hit or how == "left":
            want.append((i, k, t, *(hit or (None, None))))
    found = joins.asof(a, b, ["k"], "t", "t", ties=["v"], strict=strict, tolerance=tolerance, how=how, slices=slices)
    assert found.columns == ["id", "k", "t", "right_t", "right_v"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)


def test_asof_without_keys_and_other_times(spark):
    day = dt.date(2024, 1, 1)
    a = spark.createDataFrame([(day + dt.timedelta(days=i),) for i in range(6)], "d date")
    b = spark.createDataFrame([(day + dt.timedelta(days=i), i) for i in (1, 4)], "d date, v int")
    assert [r.b_v for r in joins.asof(a, b, [], "d", "d", "b_").orderBy("d").collect()] == [None, 1, 1, 1, 4, 4]
    at = dt.datetime(1960, 1, 1, 5)
    c = spark.createDataFrame([(at,)], "t timestamp_ntz")
    assert joins.asof(c, c.withColumn("v", F.lit(3)), [], "t", "t", "x_", tolerance=0).collect()[0].x_v == 3
    assert joins.asof(a.limit(0), b, [], "d", "d", "b_").collect() == [] and joins.asof(a, b.limit(0), [], "d", "d", "b_").filter("b_v is null").count() == 6
    with pytest.raises(ValueError):
        joins.asof(a, b, [], "d", "d", "")
    with pytest.raises(TypeError):
        joins.asof(a.select(F.lit("x").alias("d")), b, [], "d", "d", "b_")


@pytest.mark.parametrize(("how", "closed"), [("inner", True), ("left", True), ("left", False)])
def test_within(spark, sides, how, closed):
    r = random.Random(9)
    left, _, a, _ = sides
    spans = [(r.choice(["a", "b", None]), s := r.choice([None, *range(-20, 60)]), None if s is None or r.random() < 0.1 else s + r.choice([-1, 0, 1, 2, 5, 30, 500]), i) for i in range(60)]
    b = spark.createDataFrame(spans, "k string, s long, e long, v int")
    want = []
    for i, k, t in left:
        hits = [(s, e, v) for sk, s, e, v in spans if None not in (k, t, sk, s, e) and sk == k and s <= t and (t <= e if closed else t < e)]
        want += [(i, k, t, *h) for h in hits] or ([(i, k, t, None, None, None)] if how == "left" else [])
    found = joins.within(a, b, ["k"], "t", "s", "e", how=how, closed=closed)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)


def test_within_empty_sides(spark, sides):
    _, _, a, _ = sides
    none = spark.createDataFrame([], "s long, e long, v int")
    assert joins.within(a, none, [], "t", "s", "e").collect() == []
    assert joins.within(a, none, [], "t", "s", "e", how="left").filter("v is null").count() == a.count()
    assert joins.within(a.limit(0), none, [], "t", "s", "e", how="left").collect() == []
