"""Shape measurement and corpus preparation over Spark tables."""

import sys

from pyspark import cloudpickle

# Functions travel to the workers by value: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
