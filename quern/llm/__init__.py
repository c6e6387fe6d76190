"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Every operator takes DataFrames and
returns DataFrames; `queries.py` holds the thin queries that apply them to whole tables.
"""
