"""ledgerloom: document-to-record analytics and record linkage on Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Executors get the library's functions with the task, so they needn't have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
