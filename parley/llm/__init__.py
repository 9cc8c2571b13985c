"""Operators that prepare a text corpus for training; nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Executors get the operators' functions by value, so they need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
