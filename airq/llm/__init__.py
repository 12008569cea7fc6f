"""Operators for large training-data pipelines; nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# Executors get the operators' small task functions with the task, so a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
