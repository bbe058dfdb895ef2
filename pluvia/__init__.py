"""Pluvia: raster nowcast verification and corpus preparation on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value, so that a cluster needs
# no copy of the repository on its workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
