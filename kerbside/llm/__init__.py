"""Operators for preparing training text. Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Functions of this package go to the executors with the job, so they need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
