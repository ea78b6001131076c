"""Operators for training-data pipelines; nothing else in the library imports them.

Functions of this subpackage travel to executors by value, so those need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
