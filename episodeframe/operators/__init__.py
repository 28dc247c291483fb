"""Operators over episode tables: aggregates, windows, comparison, inference."""
