"""The closed registry of query functions, and what their builders work with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import QueryError
from . import kernels

INF = float("inf")


@dataclass
class Val:
    """A compiled expression. kind: num, int, bool, str, date or list; ``literal`` holds a constant's value."""

    col: Column | None
    kind: str
    literal: Any = None
    pending: bool = False

    @property
    def scalar(self) -> bool:
        return self.literal is not None


@dataclass(frozen=True)
class Function:
    name: str
    build: Callable
    least: int
    most: int
    signature: str
    description: str
    category: str
    aggregate: bool = False


REGISTRY: dict[str, Function] = {}


def function(signature: str, description: str, category: str, aggregate: bool = False):
    """Register a builder ``(ctx, *args) -> Val`` under a signature such as ``f(col, n=14)``."""
    name, _, inside = signature.partition("(")
    args = [a.strip() for a in inside.rstrip(")").split(",") if a.strip()]
    least = sum("=" not in a and not a.endswith("?") for a in args)

    def put(build: Callable) -> Callable:
        REGISTRY[name] = Function(name, build, least, len(args), signature, description, category, aggregate)
        return build

    return put


def num(v: Val | Column) -> Column:
    if isinstance(v, Column):
        return v
    if v.kind == "bool":
        return v.col.cast("int").cast("double")
    if v.kind in ("str", "date", "list"):
        raise QueryError(f"a number is needed, not a {v.kind}", "TypeError")
    return v.col.cast("double")


def truth(v: Val) -> Column:
    """A condition; missing and zero are false."""
    if v.kind == "bool":
        return F.coalesce(v.col, F.lit(False))
    return F.coalesce(num(v) != 0, F.lit(False))


def whole(v: Val, what: str = "n") -> int:
    if not v.scalar or isinstance(v.literal, (bool, str)) or int(v.literal) != v.literal:
        raise QueryError(f"{what} must be a whole number", "TypeError")
    return int(v.literal)


def constant(v: Val, what: str = "the argument") -> float:
    if not v.scalar or isinstance(v.literal, str):
        raise QueryError(f"{what} must be a number", "TypeError")
    return float(v.literal)


def divide(a: Column, b: Column) -> Column:
    """a / b with infinities for a division by zero, and nothing for 0 / 0."""
    zero = F.when(a > 0, F.lit(INF)).when(a < 0, F.lit(-INF))
    return F.when(b == 0, zero).otherwise(F.try_divide(a, b))


class Context:
    """Compiles function calls against a DataFrame of bars, which grows by helper columns."""

    def __init__(self, df: DataFrame, has_time: bool = True):
        self.df, self.has_time = df, has_time
        keys = ["symbol"] if "symbol" in df.columns else []
        self.names: dict[str, Val] = {}
        for f in df.schema:
            kind = {"boolean": "bool", "string": "str", "date": "date", "integer": "int", "long": "int"}.get(f.dataType.typeName(), "num")
            self.names[f.name] = Val(F.col(f"`{f.name}`"), kind)
        self.rows = Window.partitionBy(*keys).orderBy("ts") if has_time else Window.partitionBy(*keys)
        self.all = Window.partitionBy(*keys)
        self.keys = keys
        self.memo: dict[tuple, Val] = {}
        self.requests: list[tuple[str, tuple, list[str], list[str]]] = []
        self.count = 0

    def get(self, name: str) -> Column:
        if name not in self.names:
            raise QueryError(f"Unknown column '{name}'. Available: {', '.join(n for n in self.names if not n.startswith('__'))}", "ExpressionError")
        return num(self.names[name])

    def last(self, n: int):
        if n < 1:
            raise QueryError("the window must have at least 1 row")
        return self.rows.rowsBetween(-(n - 1), 0)

    @property
    def running(self):
        return self.rows.rowsBetween(Window.unboundedPreceding, 0)

    @property
    def ts(self) -> Column:
        if not self.has_time or "ts" not in self.names:
            raise QueryError("time functions need bars: the time is gone after a grouped step", "ExpressionError")
        return F.col("ts")

    def fresh(self) -> str:
        self.count += 1
        return f"__c{self.count}"

    def keep(self, v: Val) -> Val:
        """Compute a window expression once, as a column."""
        if v.pending:
            self.flush()
        name = self.fresh()
        self.df = self.df.withColumn(name, v.col)
        return Val(F.col(name), v.kind)

    def column(self, c: Column, kind: str = "num") -> Column:
        return self.keep(Val(c, kind)).col

    def kernel(self, kernel: str, params: tuple, inputs: list[Column | Val]) -> list[Val]:
        """Outputs of a recursion; requests are gathered and run in one pass when something needs them."""
        if any(isinstance(i, Val) and i.pending for i in inputs):
            self.flush()
        cols = [num(i) for i in inputs]
        key = (kernel, params, tuple(c._jc.toString() for c in cols))
        if key not in self.memo:
            ins = []
            for c in cols:
                same = ("in", c._jc.toString())
                if same not in self.memo:
                    name = self.fresh()
                    self.df = self.df.withColumn(name, c)
                    self.memo[same] = name
                ins.append(self.memo[same])
            outs = [self.fresh() for _ in range(kernels.KERNELS[kernel].outputs)]
            self.requests.append((kernel, params, ins, outs))
            self.memo[key] = [Val(F.col(o), "num", pending=True) for o in outs]
        return self.memo[key]

    def flush(self) -> None:
        if self.requests:
            if not self.has_time:
                raise QueryError("recursive indicators need bars: the time is gone after a grouped step", "ExpressionError")
            self.df = kernels.run(self.df, self.requests)
            self.requests = []
            for found in self.memo.values():
                for v in found if isinstance(found, list) else []:
                    v.pending = False

    def call(self, name: str, args: list[Val], in_aggregate: bool = False) -> Val:
        f = REGISTRY[name]
        if not f.least <= len(args) <= f.most:
            raise QueryError(f"{name}() takes {f.signature}, got {len(args)} arguments", "TypeError")
        if f.aggregate and in_aggregate:
            return f.build(self, None, *args)
        key = ("call", name, tuple((a.kind, a.literal, a.col._jc.toString() if a.col is not None else None) for a in args), tuple(v.col._jc.toString() for n, v in self.names.items() if n in ("open", "high", "low", "close", "volume")))
        if key not in self.memo:
            if f.aggregate:
                v = f.build(self, self.all, *args)
            else:
                v = f.build(self, *args)
            if v.pending or v.scalar:
                return v
            if "(" in v.col._jc.toString() and f.category not in ("scalar", "time", "candle"):
                v = self.keep(v)
            self.memo[key] = v
        return self.memo[key]
