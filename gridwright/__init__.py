"""Table preparation and data quality on Spark."""

import sys

from pyspark import cloudpickle

# The few functions that run inside Python workers are sent with the job, so
# the package need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
