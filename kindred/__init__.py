"""Recommendation analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Executors need no copy of this package: the small functions that run in Python workers travel
# with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
