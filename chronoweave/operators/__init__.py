"""Joins, windows, graphs, set operations and rules over change events."""
