"""Tabular modelling analytics written as Spark jobs; see README.md for the map of modules."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the Python workers with the task, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
