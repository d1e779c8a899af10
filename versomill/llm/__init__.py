"""Operators for preparing large training corpora.

Nothing outside this subpackage imports it.  Every operator is a function from
DataFrames to a DataFrame; ``queries.py`` derives the registered query results
from them.
"""
