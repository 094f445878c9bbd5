"""spanloom: interval, timeline and text analytics on Spark DataFrames."""

from pyspark import cloudpickle as _cloudpickle
import sys as _sys

# Functions of this package travel to the executors inside the task itself, so
# that a cluster needs no copy of the repository on its workers.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
