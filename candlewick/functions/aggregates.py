"""Aggregates: over all bars of a symbol in map and where, over the whole result in select."""

from __future__ import annotations

from pyspark.sql import functions as F

from .registry import Val, constant, function, num, truth


def _agg(signature, text, value, kind="num"):
    @function(signature, text, "aggregate", aggregate=True)
    def build(ctx, window, *args):
        over = (lambda c: c) if window is None else (lambda c: c.over(window))
        return Val(value(over, *args), kind)


_agg("mean(col)", "mean", lambda over, x: over(F.avg(num(x))))
_agg("sum(col)", "sum, 0 of nothing", lambda over, x: F.coalesce(over(F.sum(num(x))), F.lit(0.0)))
_agg("max(col)", "highest", lambda over, x: over(F.max(num(x))))
_agg("min(col)", "lowest", lambda over, x: over(F.min(num(x))))
_agg("std(col)", "sample deviation", lambda over, x: over(F.stddev_samp(num(x))))
_agg("median(col)", "exact median", lambda over, x: over(F.median(num(x))))
_agg("count()", "number of rows", lambda over: over(F.count(F.lit(1))), "int")
_agg("pct(condition)", "share of rows where a condition holds", lambda over, c: F.coalesce(F.try_divide(over(F.sum(truth(c).cast("double"))), over(F.count(F.lit(1)))), F.lit(0.0)))
_agg("percentile(col, p)", "interpolated quantile, p from 0 to 1", lambda over, x, p: over(F.percentile(num(x), F.lit(constant(p)))))
_agg("correlation(col1, col2)", "Pearson correlation", lambda over, a, b: over(F.corr(num(a), num(b))))


@function("last(col)", "value of the last row by time", "aggregate", aggregate=True)
def _last(ctx, window, x):
    at = F.col("ts") if ctx.has_time else F.lit(1)
    col = F.max_by(F.struct(num(x).alias("x")), at)
    return Val((col if window is None else col.over(window))["x"], "num")


#: What a grouped select may use, each of one column.
GROUPED = {
    "count": lambda x: F.count(F.lit(1)),
    "mean": F.avg,
    "sum": lambda x: F.coalesce(F.sum(x), F.lit(0.0)),
    "max": F.max,
    "min": F.min,
    "std": F.stddev_samp,
    "median": F.median,
    "pct": F.avg,
}
