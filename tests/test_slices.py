"""Sliced windows, running sums, recursions, ranks and quantiles against passes over whole keys."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from candlewick.functions.kernels import Ema, Rma
from candlewick.operators import recursions, slices

SCHEMA = "k string, t int, x double, y long, `odd.name` int"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(7)
    out = [("a", i, r.choice([None, r.gauss(0, 5), 1.5]), r.randrange(5), i) for i in range(900)]
    out += [(None, i, float(i % 7), None if i % 3 else i, 0) for i in range(150)]
    out += [("one", 3, 2.0, 1, 1), ("none", 1, None, None, None), ("none", 2, None, None, None)]
    r.shuffle(out)
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).cache()


def whole(rows):
    frame = pd.DataFrame(rows, columns=["k", "t", "x", "y", "odd"])
    frame["k"] = frame.k.fillna("(null)")
    return frame.sort_values(["k", "t"]).reset_index(drop=True)


def got(df, *names):
    frame = df.select(F.coalesce("k", F.lit("(null)")).alias("k"), "t", *names).toPandas()
    return frame.sort_values(["k", "t"]).reset_index(drop=True)


@pytest.mark.parametrize("n", [1, 3, 13])
def test_running_sums(df, rows, n):
    want = whole(rows)
    found = got(slices.running(df, ["k"], ["t"], {"sy": F.col("y"), "sx": F.col("x")}, n), "sy", "sx")
    assert found.sy.tolist() == want.y.fillna(0).astype(int).groupby(want.k).cumsum().tolist()
    assert np.allclose(found.sx, want.x.astype(float).fillna(0).groupby(want.k).cumsum(), atol=1e-9)
    assert slices.running(df, ["k"], ["t"], {"sy": F.col("y")}, n).columns == [*df.columns, "sy"]


def test_numbers_over_all_rows(df, rows):
    found = slices.numbered(df, [], ["k", "t"], "row", 5).collect()
    order = sorted(found, key=lambda r: (r.k is not None, r.k or "", r.t))
    assert [r.row for r in order] == list(range(1, len(rows) + 1))


@pytest.mark.parametrize("size", [10, 64, 65_536])
def test_windows_with_halos(df, rows, size):
    from pyspark.sql.window import Window

    def build(d, by):
        w = Window.partitionBy(*by).orderBy("t")
        return d.withColumns({"m": F.avg("x").over(w.rowsBetween(-9, 0)), "p": F.lag("x", 2).over(w), "f": F.lead("t", 3).over(w)})

    found = got(slices.windows(df, ["k"], ["t"], build, 9, 3, size), "m", "p", "f")
    by = whole(rows).groupby("k")
    want = by.x.rolling(10, min_periods=1).mean().reset_index(drop=True)
    assert np.allclose(found.m.astype(float), want, equal_nan=True, atol=1e-9)
    assert np.allclose(found.p.astype(float), by.x.shift(2).astype(float), equal_nan=True)
    assert np.allclose(found.f.astype(float), by.t.shift(-3).astype(float), equal_nan=True)


@pytest.mark.parametrize("n", [1, 4, 17])
def test_scanned_recursions_equal_the_sorted_pass(df, rows, n):
    specs = {"e3": ("ema", 3, "x"), "e20": ("ema", 20, "x"), "r2": ("rma", 2, "x"), "r14": ("rma", 14, "x"), "ry": ("rma", 5, "y")}
    found = got(slices.scanned(df, ["k"], ["t"], specs, n), *specs)
    for name, (kind, p, column) in specs.items():
        for key, own in whole(rows).groupby("k"):
            want = np.array({"ema": Ema, "rma": Rma}[kind](p)(own[column].to_numpy(float))[0])
            assert np.allclose(found[found.k == key][name].to_numpy(float), want, rtol=1e-9, atol=1e-9, equal_nan=True), (name, key)


def test_summaries_compose_wherever_a_series_is_cut():
    r = np.random.default_rng(3)
    for kind, plain, n in (("ema", Ema, 7), ("rma", Rma, 6)):
        for lost in (0.0, 0.3, 0.95):
            x = r.normal(size=700)
            x[r.random(700) < lost] = np.nan
            want = np.array(plain(n)(x)[0])
            for cuts in ([350], [1, 2, 3], sorted(r.integers(0, 700, 9)), list(range(0, 700, 11))):
                rule = recursions.RECURSIONS[kind](n)
                state, seen, out = rule.state(), 0, []
                for a, b in zip([0, *cuts], [*cuts, 700]):
                    part, middle = x[a:b], (b - a) // 2
                    y, after = rule.run(state, part, seen)
                    out.append(y)
                    first = int(np.count_nonzero(part[:middle] == part[:middle]))
                    summary = rule.extend(rule.extend(rule.summary(), part[:middle], seen), part[middle:], seen + first)
                    state = rule.advance(state, summary)
                    assert np.allclose(state, after, rtol=1e-9, atol=1e-12, equal_nan=True)
                    seen += int(np.count_nonzero(part == part))
                assert np.allclose(np.concatenate(out), want, rtol=1e-9, atol=1e-12, equal_nan=True)


@pytest.mark.parametrize("n", [1, 6])
def test_ranks_and_quantiles(df, rows, n):
    want = whole(rows)
    found = got(slices.ranked(df, ["k"], "x", "r", n), "r")
    assert np.allclose(found.r.astype(float), want.x.astype(float).groupby(want.k).rank(pct=True), equal_nan=True)
    shares = {"low": 0.0, "q": 0.37, "median": 0.5, "high": 1.0}
    table = slices.quantiles(df, ["k"], "x", shares, n).collect()
    assert {r.k for r in table} == {"a", None, "one"}
    for r in table:
        own = want[want.k == (r.k or "(null)")].x.astype(float).dropna()
        assert all(math.isclose(r[name], own.quantile(q), abs_tol=1e-9) for name, q in shares.items())
    top = slices.quantiles(df, [], "x", {"q": 0.9}, n).collect()
    assert math.isclose(top[0].q, want.x.astype(float).quantile(0.9), abs_tol=1e-9)


def test_empty_tables_and_names(spark, df):
    none = df.limit(0)
    assert slices.running(none, ["k"], ["t"], {"s": F.col("y")}).collect() == []
    assert slices.scanned(none, ["k"], ["t"], {"e": ("ema", 3, "x")}).collect() == []
    assert slices.ranked(none, ["k"], "x").collect() == [] and slices.quantiles(none, ["k"], "x", {"m": 0.5}).collect() == []
    with pytest.raises(ValueError):
        slices.running(df.withColumn("_s_key", F.lit(1)), ["k"], ["t"], {"s": F.col("y")})


def test_no_window_spans_a_key(spark):
    ticks = spark.range(4000).select(F.lit("a").alias("k"), F.lit(dt.date(2024, 1, 1)).alias("d"), F.col("id").alias("t"), F.col("id").cast("double").alias("x"))
    plan = slices.numbered(ticks, ["k"], ["t"], slices=8)._jdf.queryExecution().toString()
    spans = [line for line in plan.splitlines() if "windowspecdefinition(" in line]
    assert spans and all("_s_slice" in line or "_s_key" in line for line in spans)
