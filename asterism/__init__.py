"""Labelled semantic maps of any collection of short texts, as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel whole, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
