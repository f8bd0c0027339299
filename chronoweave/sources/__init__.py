"""Readers and parsers that turn files, artifacts and telemetry into canonical tables."""
