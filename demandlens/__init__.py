"""PySpark-native demand and ranking analytics."""

import sys

from pyspark import cloudpickle

# Executors get the functions of UDFs with each job and need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
