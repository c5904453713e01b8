"""Document retrieval and feedback analytics expressed as Spark jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package travel to the executors with the plan that uses
# them, so the cluster's Python needs no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
