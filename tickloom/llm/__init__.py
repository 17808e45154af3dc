"""Operators of a training-data pipeline, each a function from DataFrames to DataFrames.

Nothing outside this package imports it. ``queries()`` and ``oracle_sql()`` of
:mod:`tickloom.llm.registry` list the queries that apply the operators to whole tables.
"""
