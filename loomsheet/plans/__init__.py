"""Immutable request trees: filters, aggregations, lookups, updates, and their parsers."""
