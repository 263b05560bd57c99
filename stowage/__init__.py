"""Put large, messy file collections in order with Spark.

A collection is a *manifest* DataFrame (one row per file).  Operators turn it into
a *plan* DataFrame (keep, remove, move, copy, skip, error) that can be inspected,
saved and compared before an optional job applies it.
"""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel by value, so a cluster needs no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
