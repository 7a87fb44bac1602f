"""Operators for preparing training data: nothing outside this subpackage imports it.

Python functions go to executors by value, so executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
