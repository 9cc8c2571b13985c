"""Analyses of conversational transcripts, expressed as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Executors get this package's functions by value, so they need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
