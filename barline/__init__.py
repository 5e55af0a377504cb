"""barline: point-in-time analytics on daily market tables, written for Spark."""

import sys

from pyspark import cloudpickle

# Grouped pandas functions travel to executors by value, so a cluster needs no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
