"""Web-asset and training-data analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code along: executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
