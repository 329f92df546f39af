"""The query language: a flat JSON object, or a chain of them, planned as one lazy DataFrame.

Order of work, whatever the order of keys: session, period, from, map, where,
group_by and select, sort, limit. Bars of several symbols can be queried at
once: windows stay inside a symbol, and ``symbol`` is a column like any other.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import QueryError, ValidationErrors
from ..functions import REGISTRY, Context, Val
from ..functions.aggregates import GROUPED
from ..operators import timeframes as tf
from ..sources.bars import PRICES
from .expressions import Compiler, check, parse

FIELDS = {"session", "period", "from", "map", "where", "group_by", "select", "sort", "limit", "columns", "steps"}
STEP_FIELDS = FIELDS - {"steps", "columns"}
_CALL = re.compile(r"^\s*(\w+)\s*\(\s*([^(),]*?)\s*(?:,\s*([^()]*?)\s*)?\)\s*$")


@dataclass
class Plan:
    """A planned query: ``result`` is lazy. kind: table, grouped, scalar or dict."""

    result: DataFrame
    kind: str
    timeframe: str
    keys: list[str] = field(default_factory=list)
    aggregates: list[str] = field(default_factory=list)
    maps: dict[str, str] = field(default_factory=dict)
    source: DataFrame | None = None
    sort: str | None = None
    warnings: list[str] = field(default_factory=list)
    columns: list[str] | None = None


def split_select(select) -> list[str]:
    """A select as a list; a text is cut at the commas outside parentheses."""
    if isinstance(select, list):
        return [str(s).strip() for s in select]
    out, depth, now = [], 0, ""
    for c in str(select):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append(now.strip())
            now = ""
        else:
            now += c
    return [s for s in [*out, now.strip()] if s]


def alias(select: str) -> str:
    """count() is count, f(c) is f_c, f(c, d) is f_c; anything else keeps its text."""
    m = _CALL.match(select)
    if not m:
        return select
    name, first, second = m.groups()
    if not first:
        return name if second is None else select
    if second is not None and not re.fullmatch(r"\w+", second):
        return f"{name}_{first}" if re.fullmatch(r"[\w.]+", second) and re.fullmatch(r"\w+", first) else select
    return f"{name}_{first}" if re.fullmatch(r"\w+", first) else select


def keys_of(query: dict) -> list[str]:
    keys = query.get("group_by") or []
    return [keys] if isinstance(keys, str) else list(keys)


def validate(query: dict, fields: set[str] = FIELDS) -> None:
    """Everything that can be known to be wrong without data, at once."""
    errors: list[dict] = []

    def add(step, message, expression=None, hint=None):
        errors.append({k: v for k, v in {"step": step, "message": message, "expression": expression, "hint": hint}.items() if v is not None})

    if not isinstance(query, dict):
        raise ValidationErrors([{"step": "query", "message": "a query is an object"}])
    for name in query:
        if name not in fields:
            add("query", f"Unknown field '{name}'. Valid: {', '.join(sorted(fields))}")
    if "from" in query and query["from"] not in tf.TIMEFRAMES:
        add("from", f"Unknown timeframe: {query['from']}. Valid: {', '.join(tf.TIMEFRAMES)}")
    limit = query.get("limit")
    if limit is not None and (isinstance(limit, bool) or not isinstance(limit, int) or limit < 1):
        add("limit", "limit must be a whole number of at least 1")
    if query.get("steps") is not None:
        if not isinstance(query["steps"], list) or not query["steps"]:
            add("steps", "steps must be a list of queries")
        else:
            for i, one in enumerate(query["steps"]):
                try:
                    validate(one, FIELDS - {"steps"} if i == len(query["steps"]) - 1 else STEP_FIELDS)
                except ValidationErrors as e:
                    errors += [x | {"step": f"steps[{i}].{x['step']}"} for x in e.errors]

    def expression(step, text):
        try:
            check(parse(text, step), step, text)
        except QueryError as e:
            add(step, e.message, str(text), "use '==' to compare" if e.kind == "ParseError" and "'=='" in e.message else None)

    maps = query.get("map")
    if maps is not None and not isinstance(maps, dict):
        add("map", "map must be an object of expressions")
    else:
        for text in (maps or {}).values():
            expression("map", text)
    if query.get("where") is not None:
        expression("where", query["where"])
    keys = query.get("group_by")
    if keys is not None:
        for key in keys_of(query):
            if not isinstance(key, str) or not re.fullmatch(r"\w+", key):
                add("group_by", f"group_by takes column names, not '{key}'", str(key), "compute it in map first")
    if query.get("select") is not None:
        for one in split_select(query["select"]):
            if keys is not None:
                try:
                    _grouped(one)
                except QueryError as e:
                    add("select", e.message, one)
            else:
                expression("select", one)
    if query.get("columns") is not None and not (isinstance(query["columns"], list) and all(isinstance(c, str) for c in query["columns"])):
        add("columns", "columns must be a list of names")
    if errors:
        raise ValidationErrors(errors)


def _grouped(select: str):
    m = _CALL.match(select)
    name, column = (m[1], m[2]) if m else ("", "")
    if not m or name not in GROUPED or m[3] is not None:
        raise QueryError(f"'{select}' cannot be grouped: use one of {', '.join(GROUPED)} of one column", "ValidationError", "select", select)
    if name == "count":
        if column:
            raise QueryError("count() takes no column", "ValidationError", "select", select)
    elif not re.fullmatch(r"\w+", column):
        raise QueryError(f"{name}() needs a column when grouped, compute '{column}' in map first", "ValidationError", "select", select)
    return name, column


def _map_where(df: DataFrame, query: dict, has_time: bool) -> tuple[DataFrame, Context]:
    ctx = Context(df, has_time)
    compiler = Compiler(ctx, "map")
    for name, text in (query.get("map") or {}).items():
        ctx.names[name] = compiler.compile(text)
    test = None
    if query.get("where") is not None:
        test = Compiler(ctx, "where").compile(query["where"])
        if test.kind != "bool" or test.scalar:
            raise QueryError("where must be a condition on rows", "TypeError", "where", query["where"])
    ctx.flush()
    columns = [v.col.alias(n) for n, v in ctx.names.items()]
    extra = [F.col(c) for c in ctx.df.columns if c == "__session_id" and c not in ctx.names]
    out = ctx.df.select(*columns, *extra, *([test.col.alias("__keep")] if test else []))
    if test:
        out = out.filter("__keep").drop("__keep")
    return out, ctx


def _group(df: DataFrame, keys: list[str], select) -> tuple[DataFrame, list[str]]:
    for key in keys:
        if key not in df.columns:
            raise QueryError(f"Unknown column '{key}' in group_by. Available: {', '.join(c for c in df.columns if not c.startswith('__'))}", "ValidationError", "group_by", key)
    wanted = split_select(select) if select else ["count()"]
    aggregates = []
    kinds = {f.name: f.dataType.typeName() for f in df.schema}
    for one in wanted:
        name, column = _grouped(one)
        if name != "count" and column not in df.columns:
            raise QueryError(f"Unknown column '{column}' in {one}", "ValidationError", "select", one)
        x = F.lit(1) if name == "count" else F.col(f"`{column}`").cast("int").cast("double") if kinds[column] == "boolean" else F.col(f"`{column}`").cast("double")
        aggregates.append(GROUPED[name](x).alias(alias(one)))
    known = df
    for key in keys:
        known = known.filter(F.col(f"`{key}`").isNotNull())
    return known.groupBy(*keys).agg(*aggregates), [alias(o) for o in wanted]


def _select(df: DataFrame, select, has_time: bool) -> DataFrame:
    wanted = split_select(select)
    ctx = Context(df, has_time)
    compiler = Compiler(ctx, "select")
    values = [compiler.compile(one, aggregate=True) for one in wanted]
    ctx.flush()
    return ctx.df.agg(*[v.col.alias(alias(one)) for v, one in zip(values, wanted)])


def scope(bars: DataFrame, query: dict, sessions: dict | None, warnings: list[str], check_hours: bool = True) -> DataFrame:
    """Session filter, period, timeframe and session tag, in this order and below everything else."""
    named = query.get("session")
    found = None
    if named is not None:
        found = {k.upper(): v for k, v in (sessions or {}).items()}.get(str(named).upper())
        if found is None:
            warnings.append(f"Unknown session '{named}', all data is used. Known: {', '.join(sessions or {})}")
    if found:
        bars = tf.session_filter(bars, *found, check=check_hours)
    if query.get("period") is not None:
        bars = tf.period_filter(bars, str(query["period"]))
    if query.get("from") is not None:
        bars = tf.resample(bars, query["from"])
    return tf.session_tag(bars, *found) if found else bars


def default_columns(df: DataFrame, timeframe: str, keys: list[str], maps: dict[str, str], has_time: bool, symbols: bool) -> list[str]:
    lead = (["symbol"] if symbols and "symbol" in df.columns else []) + (["ts"] if has_time else [])
    order = [*lead, *keys, *[m for m in maps if m not in PRICES], *[c for c in PRICES if c in df.columns]]
    rest = [c for c in df.columns if c not in order and not c.startswith("__") and c not in ("symbol", "ts")]
    return list(dict.fromkeys(c for c in [*order, *rest] if c in df.columns))


def _sort(df: DataFrame, sort: str, has_time: bool) -> DataFrame:
    name, _, way = sort.strip().partition(" ")
    way = way.strip().lower() or "asc"
    if way not in ("asc", "desc"):
        raise QueryError(f"sort order must be asc or desc, not '{way}'", "ValidationError", "sort", sort)
    if name in ("date", "timestamp") and name not in df.columns and has_time:
        name = "ts"
    if name not in df.columns:
        raise QueryError(f"Unknown column '{name}' in sort. Available: {', '.join(c for c in df.columns if not c.startswith('__'))}", "ValidationError", "sort", sort)
    c = F.col(f"`{name}`")
    ties = [F.col(x).asc_nulls_last() for x in ("ts", "symbol") if x in df.columns and x != name]
    return df.orderBy(c.desc_nulls_last() if way == "desc" else c.asc_nulls_last(), *ties)


def plan(query: dict, bars: DataFrame, sessions: dict | None = None, symbols: bool = False) -> Plan:
    """Plan a query over bars. ``symbols`` keeps the symbol column in tables."""
    validate(query)
    warnings: list[str] = []
    steps = query.get("steps") or [query]
    first, last = {**steps[0]}, {**steps[-1]}
    for name in ("session", "period", "from"):
        if query.get("steps") and query.get(name) is not None:
            first.setdefault(name, query[name])
    timeframe = first.get("from") or "1m"
    df = scope(bars, first, sessions, warnings)
    has_time, maps = True, {}
    for i, step in enumerate(steps):
        for name, text in (step.get("map") or {}).items():
            maps[name] = text
        df, _ = _map_where(df, step, has_time)
        if i < len(steps) - 1 and step.get("group_by"):
            df, _ = _group(df, keys_of(step), step.get("select"))
            has_time = False
    columns = query.get("columns", last.get("columns"))
    out = Plan(df, "table", timeframe, maps=maps, warnings=warnings, sort=last.get("sort"), columns=columns)
    if last.get("group_by"):
        out.source, out.kind, out.keys = df, "grouped", keys_of(last)
        out.result, out.aggregates = _group(df, out.keys, last.get("select"))
        if not last.get("sort"):
            out.result = out.result.orderBy(*out.keys)
        has_time = False
    elif last.get("select"):
        wanted = split_select(last["select"])
        out.source, out.kind = df, "scalar" if len(wanted) == 1 else "dict"
        out.result, out.aggregates = _select(df, last["select"], has_time), [alias(w) for w in wanted]
        return out
    if out.kind == "table":
        out.result = df.select(*[F.col(f"`{c}`") for c in default_columns(df, timeframe, [], maps, has_time, True)])
    if last.get("sort"):
        out.result = _sort(out.result, last["sort"], has_time)
    elif out.kind == "table" and has_time and last.get("limit"):
        out.result = out.result.orderBy("ts", *(["symbol"] if "symbol" in out.result.columns else []))
    if last.get("limit"):
        out.result = out.result.limit(last["limit"])
    if out.kind == "table" and not symbols:
        out.result = out.result.drop("symbol")
    if columns:
        renamed = {"date": "ts", "time": "ts"}
        kept = [c for c in columns if c in out.result.columns or renamed.get(c) in out.result.columns]
        if kept:
            out.result = out.result.select(*[F.col(f"`{c}`") if c in out.result.columns else (F.date_format("ts", "yyyy-MM-dd") if c == "date" else F.date_format("ts", "HH:mm")).alias(c) for c in kept])
    return out


def run_query(query: dict, bars: DataFrame, **options) -> DataFrame:
    return plan(query, bars, **options).result


def route(query: dict, sessions: dict | None = None) -> str:
    """Which dataset answers a query: 1m for intraday timeframes and sessions within a day, else 1d."""
    first = (query.get("steps") or [query])[0]
    if tf.is_intraday(first.get("from", "daily")):
        return "1m"
    found = {k.upper(): v for k, v in (sessions or {}).items()}.get(str(first.get("session") or "").upper())
    return "1m" if found and tf.clock(found[0]) < tf.clock(found[1]) else "1d"


def reference_text() -> str:
    """The functions by category, from the registry."""
    groups: dict[str, list[str]] = {}
    for f in REGISTRY.values():
        groups.setdefault(f.category, []).append(f"{f.signature}: {f.description}")
    return "\n\n".join(f"{name}\n" + "\n".join(f"  {line}" for line in lines) for name, lines in groups.items())


__all__ = ["Plan", "Val", "alias", "plan", "reference_text", "route", "run_query", "scope", "split_select", "validate"]
