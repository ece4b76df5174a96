"""Operators of a training-data pipeline; nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Executors get the functions with the task, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
