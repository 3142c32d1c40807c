"""Discourse coding and corpus analytics on PySpark."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code, so a cluster needs no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
