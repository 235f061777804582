"""Dependency-graph and text-corpus analytics as PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions of this package that run inside tasks travel with their code, so
# executors need no installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
