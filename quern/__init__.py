"""Quern: corpus preparation and batching on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Executors need not have this package installed: the few Python functions that
# run on them travel with the plan instead of being imported by name.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
