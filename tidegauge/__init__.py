"""Spark-native analytics for time-ordered tables, with an optional text-corpus subpackage.

Python code that runs inside Spark tasks is shipped with each job (pickled by value), so executors
need neither this package nor a shared source folder.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.2.0"

cloudpickle.register_pickle_by_value(sys.modules[__name__])
