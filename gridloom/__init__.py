"""gridloom: error-bounded multilevel analytics of gridded fields on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions go to the executors by value: these need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
