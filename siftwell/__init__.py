"""siftwell: postings matching and reporting as Spark DataFrame jobs.

Layout
  functions/   Column -> Column helpers (no UDFs)
  operators/   DataFrame -> DataFrame building blocks
  sources/     readers for landed files, stored pages, tables and logs
  plans/       whole jobs composed from operators
  streaming/   Structured Streaming forms of the same jobs
  workload/    the named queries over the test tables, with their SQL twins
"""

import sys

from pyspark import cloudpickle

# Functions handed to mapInPandas / transformWithState travel by value, so
# executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
