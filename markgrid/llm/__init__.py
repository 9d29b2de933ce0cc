"""Operators of a training-data pipeline: filters, scans, near-duplicates, mixing and packing.

Functions of this package travel to the executors by value, so a cluster needs only the libraries.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
