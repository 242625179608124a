"""Operators for preparing training corpora. Nothing outside this package imports it."""

import sys

from pyspark import cloudpickle

# Workers get these functions by value, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
