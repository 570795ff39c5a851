"""Crowd-sourced road-defect analytics as PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

from roadfuse.config import Config

# Task functions travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Config"]
