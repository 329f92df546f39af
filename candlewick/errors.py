"""Errors that a query can end in."""

from __future__ import annotations


class QueryError(Exception):
    """A rejected query: message, kind, and the step and expression it is about."""

    def __init__(self, message: str, kind: str = "ValidationError", step: str | None = None, expression: str | None = None):
        super().__init__(message)
        self.message, self.kind, self.step, self.expression = message, kind, step, expression


class ValidationErrors(QueryError):
    """All errors found before anything ran, each with step, expression, message and perhaps a hint."""

    def __init__(self, errors: list[dict]):
        super().__init__("; ".join(e["message"] for e in errors))
        self.errors = errors
