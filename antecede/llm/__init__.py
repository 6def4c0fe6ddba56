"""Operators for training-data corpora. Nothing outside this subpackage imports it.

Functions of this package travel to Python workers by value, so the workers need not have the
repository on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
