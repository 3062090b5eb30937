"""Spark-first analytics for recorded robot motion: trajectories, point clouds, alignment and proximity graphs."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions sent to Python workers carry their code, so executors need no copy of this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
