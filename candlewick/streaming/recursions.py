"""The recursive indicators over streams of bars, with the batch engine's own kernels.

Each symbol has typed state: what the kernels carry from bar to bar, and the bars that wait. A bar
is worked out once the watermark has passed it, in order of time, so bars may come in any
order inside the allowed lateness and in any micro-batches: results are those of the sorted
pass. A timer lets a symbol's last bars out when nothing more comes for it.

Missing values are null and go through the kernels as in the batch engine. A bar later than the
watermark allows is dropped by the time its batch comes (it would have to change results that
are out already). Of bars with one time those of the earlier batch come first. The parabolic stop starts
by the second bar's close, so a symbol's first bar comes out with its second. Null symbols
are one symbol.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import kernels

NAN = float("nan")
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BAR = "ts timestamp, high double, low double, close double"
OUT = "symbol string, ts timestamp, close double, ema double, rma double, atr double, supertrend double, supertrend_dir double, sar double"
SIZES = {"ema": 2, "rma": 3, "atr": 3, "supertrend": 6, "sar": 9}
STATE = ", ".join(f"{name}{i} double" for name, n in SIZES.items() for i in range(n)) + ", before double, bars long"


def pack(kernel) -> list[float]:
    """A kernel's state as numbers, NaN for what it does not have yet."""
    if isinstance(kernel, kernels.Ema):
        return [kernel.mean, kernel.weight]
    if isinstance(kernel, kernels.Rma):
        return [float(kernel.seen), kernel.total, kernel.mean]
    if isinstance(kernel, kernels.Supertrend):
        return [0.0, *[NAN] * 5] if kernel.before is None else [1.0, *kernel.before]
    if kernel.state is None:
        return [0.0, *[NAN] * 8]
    up, sar, peak, af, highs, lows = kernel.state
    two = lambda x: (NAN, *x) if len(x) == 1 else tuple(x)
    return [1.0, float(up), sar, peak, af, *two(highs), *two(lows)]


def unpack(kernel, values: list[float]):
    """The kernel with the state that ``pack`` gave."""
    if isinstance(kernel, kernels.Ema):
        kernel.mean, kernel.weight = values
    elif isinstance(kernel, kernels.Rma):
        kernel.seen, kernel.total, kernel.mean = int(values[0]), values[1], values[2]
    elif isinstance(kernel, kernels.Supertrend):
        kernel.before = tuple(values[1:]) if values[0] else None
    elif values[0]:
        _, up, sar, peak, af, h0, h1, l0, l1 = values
        kept = lambda first, a, b: (b,) if first else (a, b)
        one = h0 != h0 and l0 != l0  # only the first bar so far
        kernel.state = (bool(up), sar, peak, af, kept(one, h0, h1), kept(one, l0, l1))
    return kernel


class Indicators(StatefulProcessor):
    def __init__(self, n_ema: float, n_rma: float, n_super: float, mult: float, accel: float, most: float):
        self.settings = (n_ema, n_rma, n_super, mult, accel, most)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.carried = handle.getValueState("carried", STATE)
        self.waiting = handle.getListState("waiting", BAR)

    def _kernels(self) -> dict:
        n_ema, n_rma, n_super, mult, accel, most = self.settings
        return {"ema": kernels.Ema(n_ema), "rma": kernels.Rma(n_rma), "atr": kernels.Rma(n_super), "supertrend": kernels.Supertrend(mult), "sar": kernels.Sar(accel, most)}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        added = [tuple(r) for part in rows for r in part[["ts", "high", "low", "close"]].itertuples(index=False)]
        yield from self._advance(key, added, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, [], timerValues.getCurrentWatermarkInMs())

    def _advance(self, key, added: list[tuple], watermark: int) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        bars = sorted([*held, *added], key=lambda r: pd.Timestamp(r[0]))
        carried = self.carried.get() if self.carried.exists() else None
        due = [r for r in bars if _ms(r[0]) <= watermark]
        if carried is None and len(due) == 1:
            due = []  # the first bar waits for the second
        rest = bars[len(due) :]
        self.waiting.clear()
        if rest:
            self.waiting.put([(pd.Timestamp(t).to_pydatetime(), *map(_plain, prices)) for t, *prices in rest])
            self.handle.registerTimer(max(_ms(rest[-1][0]), watermark + 1))
        if due:
            yield self._run(key, due, carried)

    def _run(self, key, due: list[tuple], carried) -> pd.DataFrame:
        own, before, seen = self._kernels(), NAN, 0
        if carried is not None:
            values, at = [NAN if v is None else v for v in carried], 0
            for name, n in SIZES.items():
                unpack(own[name], values[at : at + n])
                at += n
            before, seen = values[at], int(values[at + 1])
        high, low, close = (np.array([NAN if r[i] is None else r[i] for r in due], float) for i in (1, 2, 3))
        previous = np.r_[before, close[:-1]]
        # As greatest() over columns: what is missing does not count, unless all is.
        spans = np.stack([high - low, np.abs(high - previous), np.abs(low - previous)])
        true_range = np.where(np.isnan(spans).all(axis=0), NAN, np.nanmax(np.where(np.isnan(spans), -np.inf, spans), axis=0))
        atr = np.array(own["atr"](true_range)[0])
        line, way = own["supertrend"](high, low, close, atr)
        sar = own["sar"](high, low, close, np.r_[close[1:], NAN])[0]
        out = pd.DataFrame({"symbol": key[0], "ts": [pd.Timestamp(r[0]) for r in due], "close": close, "ema": own["ema"](close)[0], "rma": own["rma"](close)[0], "atr": atr, "supertrend": line, "supertrend_dir": way, "sar": sar})
        packed = [None if v != v else float(v) for name in SIZES for v in pack(own[name])]
        self.carried.update((*packed, _plain(close[-1]), seen + len(due)))
        return out

    def close(self) -> None:
        pass


def _ms(t) -> int:
    return int(pd.Timestamp(t).timestamp() * 1000)


def _plain(v) -> float | None:
    return None if v is None or v != v else float(v)


def stream_indicators(bars: DataFrame, n_ema: float = 20, n_rma: float = 14, n_super: float = 10, mult: float = 3.0, accel: float = 0.02, most: float = 0.2, late: str = "10 minutes") -> DataFrame:
    """A stream of (symbol, ts, high, low, close) with ema and rma of close, atr, SuperTrend and parabolic stop for every bar."""
    spark = bars.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in (spark.conf.get(name, "") or ""):
        raise ValueError(f"set {name} to {ROCKS}: timers and typed state need it")
    rows = bars.select("symbol", "ts", "high", "low", "close").withWatermark("ts", late)
    return rows.groupBy("symbol").transformWithStateInPandas(Indicators(n_ema, n_rma, n_super, mult, accel, most), OUT, "Append", "EventTime")

