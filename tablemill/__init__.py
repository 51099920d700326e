"""Turn corpora of many small tables into text datasets with Spark, and measure them."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with the job, so executors need no installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
