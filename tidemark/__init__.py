"""Keeping an inventory of listings in step with repeated crawls, on Spark."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their code, so that executors need not have
# this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
