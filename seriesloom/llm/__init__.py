"""Operators for building text corpora for language models. Nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# functions for tasks travel with their code, so executors need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
