"""codexferry: move exported notebook collections to a new home with Spark.

Every operator takes DataFrames or Columns and returns DataFrames or Columns.
"""

import sys

from pyspark import cloudpickle

# The small Python jobs travel with their tasks, so executors need no copy of the
# package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
