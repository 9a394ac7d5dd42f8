"""Labelled-pair corpora and similarity analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Arrow functions travel to the executors by value: nothing to install there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
