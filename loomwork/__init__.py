"""loomwork: a PySpark-native engine for web-content and training-data processing."""

import sys

from pyspark import cloudpickle

# Worker processes get our functions by value, so a cluster needs no copy of the package on its nodes.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
