"""Source-comment analytics on Spark.

Functions that run in Python workers are sent by value, so executors need not have the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
