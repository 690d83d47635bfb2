"""Hidden-state time-series analytics on Spark DataFrames."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Executors need no copy of the package: functions sent to them carry their code along.
register_pickle_by_value(sys.modules[__name__])
