"""Query expressions: a small whitelisted Python subset, checked and compiled to Columns.

Missing values follow one rule: they are null, comparisons with them are false
(``!=`` is true), and arithmetic with them gives null.
"""

from __future__ import annotations

import ast
import datetime as dt
import difflib
import operator
import re

from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions import REGISTRY, Context, Val
from ..functions.registry import divide, num, truth

_IF = re.compile(r"\bif\s*\(")
_LONE = re.compile(r"(?<![=!<>])=(?!=)")
_CHECKS = {ast.Gt: operator.gt, ast.Lt: operator.lt, ast.GtE: operator.ge, ast.LtE: operator.le, ast.Eq: operator.eq, ast.NotEq: operator.ne}
_SIGNS = {ast.Gt: ">", ast.Lt: "<", ast.GtE: ">=", ast.LtE: "<=", ast.Eq: "==", ast.NotEq: "!="}
_ARITHMETIC = (ast.Add, ast.Sub, ast.Mult, ast.Div, ast.Mod, ast.FloorDiv)


def parse(text: str, step: str | None = None) -> ast.expr:
    if not isinstance(text, str):
        raise QueryError(f"an expression must be text, not {type(text).__name__}", "TypeError", step, str(text))
    quoted = re.sub(r"'[^']*'|\"[^\"]*\"", "", text)
    if _LONE.search(quoted):
        raise QueryError(f"'=' is not a comparison, use '==': {text}", "ParseError", step, text)
    try:
        return ast.parse(_IF.sub("if_(", text).strip(), mode="eval").body
    except SyntaxError as e:
        raise QueryError(f"cannot read '{text}': {e.msg}", "ParseError", step, text) from None


def check(node: ast.AST, step: str | None = None, text: str = "") -> None:
    """Reject what the language does not have, unknown functions and wrong numbers of arguments."""

    def bad(message: str, kind: str = "ExpressionError"):
        raise QueryError(message, kind, step, text)

    if isinstance(node, ast.BinOp):
        if not isinstance(node.op, _ARITHMETIC):
            bad(f"operator {type(node.op).__name__} is not supported")
        parts = [node.left, node.right]
    elif isinstance(node, ast.UnaryOp):
        if not isinstance(node.op, (ast.USub, ast.Not)):
            bad(f"operator {type(node.op).__name__} is not supported")
        parts = [node.operand]
    elif isinstance(node, ast.BoolOp):
        parts = node.values
    elif isinstance(node, ast.Compare):
        parts = [node.left]
        for op, right in zip(node.ops, node.comparators):
            if isinstance(op, (ast.In, ast.NotIn)):
                if not isinstance(right, (ast.List, ast.Tuple)) or not all(_is_literal(x) for x in right.elts):
                    bad("'in' needs a list of constants")
            elif type(op) not in _CHECKS:
                bad(f"comparison {type(op).__name__} is not supported")
            else:
                parts.append(right)
    elif isinstance(node, ast.Call):
        if not isinstance(node.func, ast.Name):
            bad("methods cannot be called")
        name = "if" if node.func.id == "if_" else node.func.id
        if name not in REGISTRY:
            near = difflib.get_close_matches(name, REGISTRY, 3)
            bad(f"Unknown function '{name}'" + (f". Did you mean: {', '.join(near)}?" if near else ""), "UnknownFunction")
        f = REGISTRY[name]
        if not f.least <= len(node.args) <= f.most:
            bad(f"{f.signature} got {len(node.args)} arguments", "TypeError")
        parts = node.args
    elif isinstance(node, (ast.Constant, ast.Name)):
        parts = []
    else:
        bad(f"{type(node).__name__} is not supported")
    for part in parts:
        check(part, step, text)


def _is_literal(node: ast.AST) -> bool:
    return isinstance(node, ast.Constant) or (isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub) and isinstance(node.operand, ast.Constant))


def literal(value) -> Val:
    if isinstance(value, bool):
        return Val(F.lit(value), "bool", value)
    if isinstance(value, int):
        return Val(F.lit(value), "int", value)
    if isinstance(value, float):
        return Val(F.lit(value), "num", value)
    if isinstance(value, str):
        return Val(F.lit(value), "str", value)
    raise QueryError(f"constant {value!r} is not supported", "ExpressionError")


def _coerce(a: Val, b: Val) -> tuple[Val, Val]:
    """Dates meet texts as dates, conditions meet numbers as numbers."""
    if a.kind == "date" and b.kind == "str" and b.scalar:
        return a, Val(F.lit(_day(b.literal)), "date", b.literal)
    if b.kind == "date" and a.kind == "str" and a.scalar:
        return Val(F.lit(_day(a.literal)), "date", a.literal), b
    if a.kind != b.kind:
        if {a.kind, b.kind} & {"str", "date"}:
            raise QueryError(f"cannot compare {a.kind} with {b.kind}", "TypeError")
        return Val(num(a), "num", a.literal, a.pending), Val(num(b), "num", b.literal, b.pending)
    return a, b


def _day(text: str) -> dt.date:
    try:
        return dt.date.fromisoformat(text)
    except ValueError:
        raise QueryError(f"'{text}' is not a date YYYY-MM-DD", "TypeError") from None


def _compare(op: ast.cmpop, a: Val, b: Val) -> Val:
    a, b = _coerce(a, b)
    if a.kind == "bool" and b.kind == "bool":
        a, b = Val(a.col.cast("int"), "int"), Val(b.col.cast("int"), "int")
    return Val(F.coalesce(_CHECKS[type(op)](a.col, b.col), F.lit(isinstance(op, ast.NotEq))), "bool", pending=a.pending or b.pending)


class Compiler:
    """Compiles checked expressions in a context; ``aggregate`` makes aggregates global ones."""

    def __init__(self, ctx: Context, step: str | None = None):
        self.ctx, self.step = ctx, step

    def compile(self, text: str, aggregate: bool = False) -> Val:
        node = parse(text, self.step)
        check(node, self.step, text)
        try:
            return self._eval(node, aggregate)
        except QueryError as e:
            e.step, e.expression = e.step or self.step, e.expression or text
            raise

    def _eval(self, node: ast.AST, aggregate: bool) -> Val:
        ev = lambda n: self._eval(n, aggregate)
        if isinstance(node, ast.Constant):
            return literal(node.value)
        if isinstance(node, ast.Name):
            if node.id in ("true", "false"):
                return literal(node.id == "true")
            if node.id not in self.ctx.names:
                self.ctx.get(node.id)
            if aggregate:
                raise QueryError(f"'{node.id}' must stand inside an aggregate function", "ExpressionError")
            return self.ctx.names[node.id]
        if isinstance(node, ast.BinOp):
            return self._arithmetic(node.op, ev(node.left), ev(node.right))
        if isinstance(node, ast.UnaryOp):
            v = ev(node.operand)
            if isinstance(node.op, ast.Not):
                return Val(~truth(v), "bool", pending=v.pending)
            if v.scalar and not isinstance(v.literal, (bool, str)):
                return literal(-v.literal)
            return Val(-(v.col if v.kind == "int" else num(v)), "int" if v.kind == "int" else "num", pending=v.pending)
        if isinstance(node, ast.BoolOp):
            parts = [ev(n) for n in node.values]
            out = truth(parts[0])
            for p in parts[1:]:
                out = out & truth(p) if isinstance(node.op, ast.And) else out | truth(p)
            return Val(out, "bool", pending=any(p.pending for p in parts))
        if isinstance(node, ast.Compare):
            left, out, pending = ev(node.left), None, False
            for op, right in zip(node.ops, node.comparators):
                if isinstance(op, (ast.In, ast.NotIn)):
                    items = [ev(x) for x in right.elts]
                    found = F.lit(False)
                    for item in items:
                        a, b = _coerce(left, item)
                        found = found | F.coalesce(a.col == b.col, F.lit(False))
                    one, nxt = Val(~found if isinstance(op, ast.NotIn) else found, "bool", pending=left.pending), left
                else:
                    nxt = ev(right)
                    one = _compare(op, left, nxt)
                out = one.col if out is None else out & one.col
                pending |= one.pending
                left = nxt
            return Val(out, "bool", pending=pending)
        name = "if" if node.func.id == "if_" else node.func.id
        f = REGISTRY[name]
        if aggregate and f.aggregate:
            args = [self._eval(a, False) for a in node.args]
            kept = [self.ctx.keep(a) if not a.scalar and "(" in a.col._jc.toString() else a for a in args]
            if any(a.pending for a in kept):
                self.ctx.flush()
            return self.ctx.call(name, kept, in_aggregate=True)
        args = [ev(a) for a in node.args]
        if f.aggregate and any(a.pending for a in args):
            self.ctx.flush()
        return self.ctx.call(name, args)

    def _arithmetic(self, op: ast.operator, a: Val, b: Val) -> Val:
        pending = a.pending or b.pending
        if a.kind == b.kind == "int" and isinstance(op, (ast.Add, ast.Sub, ast.Mult)):
            x, y = a.col.cast("long"), b.col.cast("long")
            kind = "int"
        else:
            x, y, kind = num(a), num(b), "num"
        if isinstance(op, ast.Add):
            out = x + y
        elif isinstance(op, ast.Sub):
            out = x - y
        elif isinstance(op, ast.Mult):
            out = x * y
        elif isinstance(op, ast.Div):
            out = divide(x, y)
        else:
            down = F.floor(F.when(y != 0, F.try_divide(x, y))).cast("double")
            out = down if isinstance(op, ast.FloorDiv) else x - down * y
        return Val(out, kind, pending=pending)
