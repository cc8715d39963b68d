"""ebbflow: low-flow and drought analytics as Spark DataFrame operators.

Every operator takes and returns DataFrames.  The canonical input is a long table of daily
observations ``series_id, time, value`` holding any number of series.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The few Arrow functions travel with the query, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
