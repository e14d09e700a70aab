"""Operators for preparing language-model training data, as Spark jobs.

Nothing outside this subpackage imports it. `registry` holds the registered queries.
"""
