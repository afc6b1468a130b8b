"""Expressions as Spark SQL text, for ``selectExpr``, ``expr`` and ``where``.

Arguments are column names or SQL expressions written by the caller; values
that come from a user go through ``lit`` in ``scope`` instead.  Everything is a
Spark built-in, nothing is a Python UDF.
"""
