"""Document lakehouse operators for Spark: parse, chunk, embed, store and search."""

import sys

from pyspark import cloudpickle

# Batch functions travel to the executors by value, so a job needs no package install there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
