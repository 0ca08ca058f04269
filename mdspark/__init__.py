"""Batch analytics on Spark DataFrames for reactive-simulation output."""

import sys

from pyspark import cloudpickle

# Executors need no copy of this package on their own path: functions are shipped by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
