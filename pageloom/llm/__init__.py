"""Operators for training-data pipelines, their queries and statements."""

import sys

from pyspark import cloudpickle

# Functions of this folder travel to the executors whole, which then need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
