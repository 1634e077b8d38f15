"""Operators for preparing language-model training text.

Nothing outside this subpackage imports it.  Every operator takes DataFrames
and column names and returns DataFrames; the modules end with the thin
``opN_<name>`` query that applies the operator to its production table.
"""
