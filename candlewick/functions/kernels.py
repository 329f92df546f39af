"""Recursions that no bounded window frame expresses, run as one pass over sorted bars.

Bars are partitioned by symbol and sorted by time; a Python task walks through
its partition batch by batch and carries each recursion's state from one batch
to the next, so a symbol's whole history is never held in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MISSING = float("nan")


class Ema:
    """Exponential mean, alpha 2/(n+1), from the first value on; a missing value repeats the mean and ages it."""

    outputs = 1

    def __init__(self, n: float):
        self.alpha, self.mean, self.weight = 2.0 / (n + 1.0), MISSING, 1.0

    def __call__(self, x: np.ndarray) -> list[list[float]]:
        alpha, keep, mean, weight, out = self.alpha, 1.0 - self.alpha, self.mean, self.weight, []
        for v in x.tolist():
            if mean != mean:
                if v == v:
                    mean, weight = v, 1.0
            else:
                weight *= keep
                if v == v:
                    mean = (weight * mean + alpha * v) / (weight + alpha)
                    weight = 1.0
            out.append(mean)
        self.mean, self.weight = mean, weight
        return [out]


class Rma:
    """Wilder's mean: the plain mean of the first n values, then alpha 1/n; a missing value repeats the result."""

    outputs = 1

    def __init__(self, n: float):
        self.n, self.seen, self.total, self.mean = max(1, int(n)), 0, 0.0, MISSING

    def __call__(self, x: np.ndarray) -> list[list[float]]:
        n, out = self.n, []
        old = 1.0 - 1.0 / n
        for v in x.tolist():
            if v == v:
                if self.seen < n:
                    self.seen += 1
                    self.total += v
                    if self.seen == n:
                        self.mean = self.total / n
                else:
                    self.mean = v / n + old * self.mean
            out.append(self.mean)
        return [out]


class Supertrend:
    """Ratcheting bands around the mid price; gives the line and its direction (1 up, -1 down)."""

    outputs = 2

    def __init__(self, mult: float):
        self.mult, self.before = mult, None

    def __call__(self, high, low, close, atr) -> list[list[float]]:
        line, way = [], []
        for h, lo, c, a in zip(high.tolist(), low.tolist(), close.tolist(), atr.tolist()):
            if self.before is None:
                self.before = (c, MISSING, MISSING, MISSING, MISSING)
                line.append(MISSING)
                way.append(MISSING)
                continue
            c0, a0, upper0, lower0, line0 = self.before
            if a != a:
                self.before = (c, a, upper0, lower0, line0)
                line.append(MISSING)
                way.append(MISSING)
                continue
            mid = (h + lo) / 2.0
            upper, lower = mid + self.mult * a, mid - self.mult * a
            if lower0 == lower0 and not (lower > lower0 or c0 < lower0):
                lower = lower0
            if upper0 == upper0 and not (upper < upper0 or c0 > upper0):
                upper = upper0
            if a0 != a0 or line0 != line0:
                up = False
            elif line0 == upper0:
                up = c > upper
            else:
                up = not c < lower
            now = lower if up else upper
            line.append(now)
            way.append(1.0 if up else -1.0)
            self.before = (c, a, upper, lower, now)
        return [line, way]


class Sar:
    """Parabolic stop and reverse. The start depends on the close of the bar after, which is an input."""

    outputs = 1

    def __init__(self, accel: float, most: float):
        self.accel, self.most = accel, most
        self.state = None

    def __call__(self, high, low, close, following) -> list[list[float]]:
        out: list[float] = []
        for h, lo, c, c1 in zip(high.tolist(), low.tolist(), close.tolist(), following.tolist()):
            if self.state is None:
                up = c1 >= c
                self.state = (up, lo if up else h, h if up else lo, self.accel, (h,), (lo,))
                out.append(self.state[1] if c1 == c1 else MISSING)
                continue
            up, sar, peak, af, highs, lows = self.state
            s = sar + af * (peak - sar)
            if up:
                s = min(s, *lows)
                if lo < s:
                    up, s, peak, af = False, peak, lo, self.accel
                elif h > peak:
                    peak, af = h, min(af + self.accel, self.most)
            else:
                s = max(s, *highs)
                if h > s:
                    up, s, peak, af = True, peak, h, self.accel
                elif lo < peak:
                    peak, af = lo, min(af + self.accel, self.most)
            out.append(s)
            self.state = (up, s, peak, af, (*highs[-1:], h), (*lows[-1:], lo))
        return [out]


KERNELS = {"ema": Ema, "rma": Rma, "supertrend": Supertrend, "sar": Sar}


def run(df: DataFrame, requests: list[tuple[str, tuple, list[str], list[str]]]) -> DataFrame:
    """``df`` with the outputs of all requested recursions: (kernel, parameters, input columns, output columns).

    One shuffle by symbol at most (none where the rows already lie so) and one
    pass in Python; only the inputs and a row number cross to it and back with
    the rows they belong to.
    """
    names = [f.name for f in df.schema]
    outs = [o for r in requests for o in r[3]]
    at = {n: i for i, n in enumerate(names)}

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol, states = object(), []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            keys = batch.column(at["symbol"]).to_pylist()
            edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            results: list[list[float]] = [[] for _ in outs]
            for a, b in zip(edges, edges[1:]):
                if keys[a] != symbol:
                    symbol, states = keys[a], [KERNELS[k](*p) for k, p, _, _ in requests]
                k = 0
                for state, (_, _, ins, own) in zip(states, requests):
                    arrays = [batch.column(at[i]).slice(a, b - a).cast(pa.float64()).to_numpy(zero_copy_only=False) for i in ins]
                    for values in state(*arrays):
                        results[k] += values
                        k += 1
            new = [pa.array(np.array(r, float), from_pandas=True) for r in results]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*names, *outs])

    schema = df.schema
    for o in outs:
        schema = schema.add(o, "double")
    return df.repartition("symbol").sortWithinPartitions("symbol", "ts").mapInArrow(walk, schema)
