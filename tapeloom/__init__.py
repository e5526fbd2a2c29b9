"""Market-tape analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package travel to the executors by value, so a cluster needs no install and the
# driver's working directory does not matter.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
