"""Operators for training-data pipelines; nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

from loglake.llm.registry import oracle_sql, queries

# functions travel to the workers whole, so executors need no copy of this package on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["oracle_sql", "queries"]
