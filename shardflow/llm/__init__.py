"""Operators for large training-data pipelines.

Nothing outside this subpackage imports it.  Every operator takes and returns DataFrames; the thin
``opN_*`` queries in :mod:`shardflow.llm.queries` apply the operators to whole tables.
"""
