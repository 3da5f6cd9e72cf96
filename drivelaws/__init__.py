"""Customer-usage laws from vehicle signals, trips and criteria, as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# The few pandas UDFs travel with their code, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
