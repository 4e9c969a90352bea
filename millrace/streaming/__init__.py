"""Incremental aggregates and concurrent serving."""
