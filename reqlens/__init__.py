"""Web-request threat analytics on Spark DataFrames and structured streams."""

import sys

from pyspark import cloudpickle

# Python tasks get the package's functions with the plan, so executors need no installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
