"""Operators for training-data pipelines. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Functions go to Python workers whole, so that executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
