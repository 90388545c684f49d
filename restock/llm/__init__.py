"""Operators for building training data: near-dedup, language ID, secret scans, scoring, packing, search.

Functions of this package run inside Spark tasks. They are pickled by value, so that executors
need no copy of the repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
