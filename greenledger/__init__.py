"""Spark jobs for public-evidence archives and project feasibility screening."""

import sys

from pyspark import cloudpickle

# Functions sent to the executors travel by value, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
