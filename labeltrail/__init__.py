"""Sequence-anomaly analytics on event logs, built from Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Task functions carry their code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
