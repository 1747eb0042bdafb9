"""Text-corpus preparation and tokenization analytics as Spark jobs."""

import sys

from pyspark import cloudpickle

# The few functions that run in Python tasks travel with their job, so executors
# need not have this package installed or on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
