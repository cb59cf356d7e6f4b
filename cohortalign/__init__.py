"""Cross-subject response modelling as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions travel to the executors by value, so the package is needed on the driver only.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
