"""Multi-vector retrieval and data processing on Spark.

Functions of the package travel to the executors by value, so that a cluster needs no copy of it.
"""

import sys

from pyspark import cloudpickle as _cloudpickle

_cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
