"""Roster analytics on Spark: lineups, vectors, search, clustering and match analytics as DataFrame plans."""

import sys

from pyspark import cloudpickle

# Functions for Python workers travel by value, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
