"""weftgraph: import-graph analytics for many projects at once, on Spark.

Every operator takes and returns DataFrames whose first column is
``project_id``; no operator loops over projects on the driver.
"""

import sys

from pyspark import cloudpickle

# The few Python helpers travel with the task, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
