"""Operators for large training corpora: each takes and returns DataFrames.

Nothing else in the library imports this package.
"""
