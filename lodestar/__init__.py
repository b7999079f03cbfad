"""Spark-native code-index analytics: scan, extract, index, query and export source trees as DataFrames."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions of this package travel to the executors by value, so workers need not have it installed.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
