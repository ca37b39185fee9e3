"""Spatio-temporal change and evidence-graph analytics as PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

# functions shipped to Python workers travel by value, so executors need no install
cloudpickle.register_pickle_by_value(sys.modules[__name__])
