"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage. Each operator takes and
returns DataFrames; ``queries.py`` holds the thin contract queries.
"""
