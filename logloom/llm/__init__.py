"""Operators for training-data pipelines, each a Spark job over whole tables."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with them, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
