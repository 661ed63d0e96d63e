"""Operators of a training-data pipeline over documents. Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Task code travels with the job, so the executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
