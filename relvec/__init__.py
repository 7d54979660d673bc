"""Embedding features and relevance classification as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code with them, so no worker needs this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
