"""Tessera: statistical table operations as Spark DataFrame transformations."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value, so that a cluster needs no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
