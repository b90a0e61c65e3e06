"""Ready queries over the analytic tables, each with an equivalent SQL text where one exists."""

from . import library, search, series
from . import display, flows  # isort: skip  (build on others)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "display", "flows", "library", "search", "series"]
