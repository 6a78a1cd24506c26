"""Corpus operators for language-model training data.

Nothing else in the library imports this subpackage. Each operator module has a
general function on DataFrames; ``queries`` holds the thin registered queries.
"""
