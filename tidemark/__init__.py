"""Tidemark: question answering over documents as Spark jobs.

Every operator takes DataFrames and returns DataFrames.  Nothing keeps state in the
driver process; state that has to survive a job is a table.
"""

import sys

from pyspark import cloudpickle

# Functions travel to the executors by value, so a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
