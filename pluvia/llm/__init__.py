"""Operators that prepare text, page and vector tables for model training."""
