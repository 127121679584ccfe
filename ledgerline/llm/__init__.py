"""Operators for building language-model training data."""

import sys

from pyspark import cloudpickle

# tasks carry their helpers with them: executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
