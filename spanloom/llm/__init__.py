"""Operators for training-data pipelines, one module each.

Nothing outside this subpackage imports it.  Every operator takes DataFrames
and column names; the thin ``opN_*`` queries in ``queries.py`` apply them to
whole tables with production parameters.
"""
