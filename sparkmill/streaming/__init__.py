"""Incremental versions of the abundance and bin aggregates."""
