"""Registered queries: operators over the canonical tables, each with SQL that says the same to DuckDB."""

from . import code, history, parsing, reading, reporting, rules, state, structure
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "code", "history", "parsing", "reading", "reporting", "rules", "state", "structure"]
