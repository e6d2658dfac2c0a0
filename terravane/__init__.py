"""terravane: region, hierarchy and similarity-graph analytics expressed as Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions handed to Python workers travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
