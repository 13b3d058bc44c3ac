"""Operators for preparing training data for language models."""

import sys

from pyspark import cloudpickle

# Executors get the functions with each job and need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
