"""The answer to a query: formatted rows, a summary and what it was made from.

Everything up to here is lazy. Formatting is one more projection; the summary
is aggregates over the result; only a bounded number of rows reaches the driver.
"""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import timeframes as tf
from ..sources.bars import PRICES
from .query import Plan, plan

DAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
PLAIN = {*PRICES, "ts"}


def _names(c: Column, names: tuple, first: int) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), c.cast("int") - first + 1)


def labels(expression: str, c: Column) -> Column | None:
    """Labels for a column that is just a weekday, month or hour."""
    text = expression.strip()
    if text == "dayofweek()":
        return _names(c, DAYS, 0)
    if text == "month()":
        return _names(c, MONTHS, 1)
    if text == "hour()":
        return F.format_string("%02d:00-%02d:59", c.cast("int"), c.cast("int"))
    return None


def formatted(p: Plan) -> DataFrame:
    """Result columns as they are shown: dates and times split, computed numbers at 4 decimals, labels."""
    out = []
    for f in p.result.schema:
        c, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        label = labels(p.maps[f.name], c) if f.name in p.maps and not p.columns else None
        if f.name == "ts":
            out.append(F.date_format(c, "yyyy-MM-dd").alias("date"))
            if tf.is_intraday(p.timeframe):
                out.append(F.date_format(c, "HH:mm").alias("time"))
        elif label is not None:
            out.append(label.alias(f.name))
        elif kind == "date":
            out.append(F.date_format(c, "yyyy-MM-dd").alias(f.name))
        elif kind == "double" and f.name not in PLAIN:
            finite = F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(F.bround(c, 4))
            out.append(finite.alias(f.name))
        else:
            out.append(c)
    return p.result.select(*out)


def json_rows(p: Plan) -> DataFrame:
    """The formatted result as JSON lines, nulls kept."""
    rows = formatted(p)
    return rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"ignoreNullFields": "false"}).alias("value"))


def statistics(p: Plan) -> DataFrame:
    """One row: the number of rows, and min, max and mean of mapped and sorted numeric columns."""
    rows = formatted(p)
    numeric = {f.name for f in rows.schema if f.dataType.typeName() in ("double", "integer", "long", "boolean")}
    wanted = [m for m in p.maps if m in numeric]
    sort = (p.sort or "").split(" ")[0]
    if sort in numeric and sort not in wanted:
        wanted.append(sort)
    aggregates = [F.count(F.lit(1)).alias("rows")]
    for name in wanted:
        c = F.col(f"`{name}`").cast("double")
        aggregates += [F.min(c).alias(f"{name}_min"), F.max(c).alias(f"{name}_max"), F.bround(F.avg(c), 2).alias(f"{name}_mean")]
    return rows.agg(*aggregates)


def extremes(p: Plan) -> DataFrame:
    """For a grouped result, the rows where the first aggregate is lowest and highest."""
    rows, name = formatted(p), p.aggregates[0]
    row = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    return rows.agg(F.min_by(row, F.col(f"`{name}`")).alias("min_row"), F.max_by(row, F.col(f"`{name}`")).alias("max_row"))


def _plain(v):
    if isinstance(v, float) and (math.isnan(v) or math.isinf(v)):
        return None
    if isinstance(v, (dt.date, dt.datetime)):
        return v.isoformat()
    return v


def respond(query: dict, bars: DataFrame, sessions: dict | None = None, rows: int = 500) -> dict:
    """Run a query and build the envelope, which shows the first ``rows`` rows of the table and of its source; counts, statistics, first and last are of all."""
    p = plan(query, bars, sessions)
    out: dict = {"query": query, "metadata": {"timeframe": p.timeframe, "kind": p.kind, "warnings": p.warnings}, "table": None, "source_rows": None, "source_row_count": None, "chart": None}
    source = p.source.persist() if p.source is not None else None
    try:
        if source is not None:
            shown = Plan(source.select(*[c for c in source.columns if not c.startswith("__") and c != "symbol"]), "table", p.timeframe, maps=p.maps, columns=p.columns)
            out["source_row_count"] = source.count()
            out["source_rows"] = [{k: _plain(v) for k, v in r.asDict().items()} for r in formatted(shown).limit(rows).collect()]
        if p.kind in ("scalar", "dict"):
            values = {k: _plain(v) for k, v in p.result.first().asDict().items()}
            out["summary"] = {"type": p.kind, "value": next(iter(values.values()))} if p.kind == "scalar" else {"type": "dict", "values": values}
            return out
        out["table"] = [{k: _plain(v) for k, v in r.asDict().items()} for r in formatted(p).limit(rows).collect()]
        stats = {k: _plain(v) for k, v in statistics(p).first().asDict().items()}
        total = stats.pop("rows")
        last = out["table"][-1:] if total <= rows else [{k: _plain(v) for k, v in r.asDict().items()} for r in formatted(p).tail(1)]
        out["summary"] = {"type": p.kind, "rows": total, "stats": stats, "first": out["table"][:1], "last": last}
        if p.kind == "grouped":
            row = extremes(p).first()
            out["summary"] |= {"by": p.keys, "min_row": row.min_row and {k: _plain(v) for k, v in row.min_row.asDict().items()}, "max_row": row.max_row and {k: _plain(v) for k, v in row.max_row.asDict().items()}}
            out["chart"] = {"category": p.keys[0], "value": p.aggregates[0]}
        return out
    finally:
        if source is not None:
            source.unpersist()


def describe(answer: dict) -> str:
    """A short text about an answer."""
    s = answer["summary"]
    if s["type"] == "scalar":
        return f"Result: {s['value']}"
    if s["type"] == "dict":
        return "Result: " + ", ".join(f"{k} = {v}" for k, v in s["values"].items())
    lines = [f"{s['rows']} rows" + (f" by {', '.join(s['by'])}" if s["type"] == "grouped" else "")]
    names = dict.fromkeys(k.rsplit("_", 1)[0] for k in s["stats"])
    lines += [f"  {n}: min {s['stats'][n + '_min']}, max {s['stats'][n + '_max']}, mean {s['stats'][n + '_mean']}" for n in names]
    return "\n".join(lines)
