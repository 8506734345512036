"""sieveline: document analytics, corpus preparation and hybrid retrieval on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions for executors travel with their code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
