"""Docket analytics on Spark: ingest, select, score, tag, digest and corpus jobs.

Every public function takes and returns DataFrames (or Columns) and is lazy;
only sinks and the streaming entry points start Spark jobs.
"""

import sys

from pyspark import cloudpickle

# Arrow functions travel to the Python workers by value, so a session that was
# started without this package on the executors' path can still run them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
