"""Spark jobs that parse exported git history at scale; subpackage llm prepares training data."""

import sys

from pyspark import cloudpickle

# Tasks get this package's functions by value, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
