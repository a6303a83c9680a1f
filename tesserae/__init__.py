"""tesserae: a PySpark-native chunk codec and array-transform engine."""

import sys

from pyspark import cloudpickle

# Kernels travel to the executors with the plan, so a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
