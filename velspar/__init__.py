"""velspar: similarity retrieval, retrieval evaluation and corpus preparation as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the Python workers by value, so executors need no copy of the repository.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
