"""The query functions by category."""

from . import aggregates, indicators, rows, windows  # noqa: F401
from .registry import REGISTRY, Context, Val  # noqa: F401
