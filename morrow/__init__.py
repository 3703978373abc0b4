"""Next-day recommendation analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The few Arrow functions travel to the executors by value, so a job does not need
# the package installed on every worker.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
