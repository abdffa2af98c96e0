"""Analytics operators on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with the task, so a cluster needs no
# copy of this package on its Python path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
