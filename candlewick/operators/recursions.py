"""Linear recursions that can be composed: what a stretch of values does to whatever came before it.

A stretch is summarized without knowing the value before it (``summary``, ``extend``);
summaries are applied in order (``state``, ``advance``), and a stretch is worked out
from its true start (``run``). States and summaries are short lists of floats. NaN is a
missing value. The arithmetic agrees with the sorted pass of ``functions.kernels``.
"""

from __future__ import annotations

import numpy as np

BLOCK = 128
NAN = float("nan")


def smooth(x: np.ndarray, alpha: float, y: float) -> np.ndarray:
    """y[i] = (1 - alpha) * y[i-1] + alpha * x[i] from ``y`` on, block by block: inside a block as one matrix product."""
    if not len(x):
        return x
    steps = np.arange(BLOCK)
    keep = 1.0 - alpha
    lags = steps[:, None] - steps[None, :]
    weights = np.where(lags >= 0, alpha * np.power(keep, np.maximum(lags, 0)), 0.0)
    padded = np.zeros(-(-len(x) // BLOCK) * BLOCK)
    padded[: len(x)] = x
    out = padded.reshape(-1, BLOCK) @ weights.T
    decay = np.power(keep, steps + 1)
    for row in out:
        row += decay * y
        y = row[-1]
    return out.reshape(-1)[: len(x)]


class Wilder:
    """The plain mean of the first n values, then alpha 1/n; a missing value repeats the result."""

    def __init__(self, n: float):
        self.n = max(1, int(n))
        self.alpha = 1.0 / self.n

    def state(self) -> list[float]:
        return [0.0, NAN]  # sum of the seed, value

    def summary(self) -> list[float]:
        return [0.0, 0.0, 1.0, 0.0]  # sum of what belongs to the seed, whether the seed ends here, map a, map b

    def extend(self, summary: list[float], x: np.ndarray, seen: int) -> list[float]:
        total, ends, a, b = summary
        x = x[x == x]
        need = max(0, self.n - seen)
        total += float(x[:need].sum())
        if need and len(x) >= need:
            ends = 1.0
        rest = x[need:]
        if len(rest):
            a *= (1.0 - self.alpha) ** len(rest)
            b = float(smooth(rest, self.alpha, b)[-1])
        return [total, ends, a, b]

    def advance(self, state: list[float], summary: list[float]) -> list[float]:
        total, value = state
        more, ends, a, b = summary
        total += more
        if ends:
            value = total / self.n
        return [total, a * value + b if value == value else value]

    def run(self, state: list[float], x: np.ndarray, seen: int) -> tuple[np.ndarray, list[float]]:
        total, value = state
        have = x == x
        given = x[have]
        need = max(0, self.n - seen)
        total += float(given[:need].sum())
        y = np.full(len(given), NAN)
        if need and len(given) >= need:
            value = total / self.n
            y[need - 1] = value
        if len(given) > need:
            y[need:] = smooth(given[need:], self.alpha, value)
        out = np.r_[state[1], y][np.cumsum(have)]  # a missing value repeats the result
        return out, [total, float(out[-1]) if len(out) else value]


class Exponential:
    """Alpha 2/(n+1) from the first value on; a missing value repeats the mean and ages it, so that the next value weighs more."""

    def __init__(self, n: float):
        self.alpha = 2.0 / (n + 1.0)

    def state(self) -> list[float]:
        return [NAN, 0.0]  # mean, missing values since the last one

    def summary(self) -> list[float]:
        return [0.0, NAN, 1.0, 0.0, 0.0]  # missing before the first value, the first value, map a, map b, missing after the last

    def _steps(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the values after the first: how much of the mean stays at each, by the missing ones before it."""
        at = np.flatnonzero(x == x)
        weight = np.power(1.0 - self.alpha, np.diff(at).astype(float))
        return at, weight / (weight + self.alpha)

    def extend(self, summary: list[float], x: np.ndarray, seen: int) -> list[float]:
        before, first, a, b, after = summary
        if first == first:  # go on from the last value, whose age is ``after``
            return [before, first, *self._fold(a, b, x, after)]
        have = np.flatnonzero(x == x)
        if not len(have):
            return [before + len(x), first, a, b, 0.0]
        k = int(have[0])
        return [before + k, float(x[k]), *self._fold(1.0, 0.0, x[k + 1 :], 0.0)]

    def _fold(self, a: float, b: float, x: np.ndarray, age: float) -> tuple[float, float, float]:
        """The map (a, b) followed by the steps of x, and the missing values after the last."""
        at = np.flatnonzero(x == x)
        if len(at) == len(x) and not age:
            return (a * (1.0 - self.alpha) ** len(x), float(smooth(x, self.alpha, b)[-1]), 0.0) if len(x) else (a, b, 0.0)
        if not len(at):
            return a, b, age + len(x)
        for keep, v in zip(self._keep(at, age).tolist(), x[at].tolist()):
            a, b = keep * a, keep * b + (1.0 - keep) * v
        return a, b, float(len(x) - 1 - at[-1])

    def _keep(self, at: np.ndarray, age: float) -> np.ndarray:
        weight = np.power(1.0 - self.alpha, np.diff(np.r_[-1.0 - age, at]))
        return weight / (weight + self.alpha)

    def advance(self, state: list[float], summary: list[float]) -> list[float]:
        mean, age = state
        before, first, a, b, after = summary
        if first != first:
            return [mean, age + before if mean == mean else 0.0]
        if mean == mean:
            keep = float(self._keep(np.array([before]), age)[0])
            first = keep * mean + (1.0 - keep) * first
        return [a * first + b, after]

    def run(self, state: list[float], x: np.ndarray, seen: int) -> tuple[np.ndarray, list[float]]:
        mean, age = state
        at = np.flatnonzero(x == x)
        given = x[at]
        if not len(at):
            return np.full(len(x), mean), [mean, age + len(x) if mean == mean else 0.0]
        y, start = np.empty(len(at)), 0
        if mean != mean:
            y[0], start = given[0], 1
            mean = float(given[0])
            keep = np.r_[0.0, self._keep(at[1:] - at[0] - 1.0, 0.0)]
        else:
            keep = self._keep(at, age)
        if np.allclose(keep[start:], 1.0 - self.alpha, rtol=1e-15, atol=0):
            y[start:] = smooth(given[start:], self.alpha, mean)
        else:
            for i in range(start, len(at)):
                mean = keep[i] * mean + (1.0 - keep[i]) * given[i]
                y[i] = mean
        out = np.r_[state[0], y][np.cumsum(x == x)]
        return out, [float(y[-1]), float(len(x) - 1 - at[-1])]


RECURSIONS = {"ema": Exponential, "rma": Wilder}
