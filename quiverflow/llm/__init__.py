"""Operators of a training-data pipeline.

Nothing outside this package imports it.  Its functions travel to the Python
workers by value, so executors need no copy of the repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
