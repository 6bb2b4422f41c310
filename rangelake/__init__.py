"""Radar and camera sensing analytics on Spark DataFrames and Structured Streaming."""

import sys

from pyspark import cloudpickle

# Executors need not have this package installed: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
