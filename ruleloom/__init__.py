"""Rule-driven auditing of large text and source corpora on Spark.

Functions of the package travel to executors by value, so those need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
