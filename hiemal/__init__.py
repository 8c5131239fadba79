"""hiemal: station-series, grid and multi-day-event analytics on Spark DataFrames."""
import sys

from pyspark import cloudpickle

# Arrow functions travel with the job, so executors do not need this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
