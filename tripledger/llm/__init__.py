"""Operators for training data. Their functions travel with the tasks that run them, so
executors need no copy of the package."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
