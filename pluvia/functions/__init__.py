"""Expressions and aggregates by name."""
