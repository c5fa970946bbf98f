"""Sensor-test analytics on Spark: DataFrame-to-DataFrame operators over many tests at once."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so workers need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
