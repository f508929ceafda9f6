"""Spark-native analytics for aerial-imagery detection data.

Every public function takes and returns DataFrames (or Columns); nothing is
collected to the driver except bounded control values such as row counts.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The few functions that run in Python workers travel with the job, so executors
# need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
