"""Operators for preparing large text corpora, one module per operator.

Nothing outside this folder imports it. Functions that run in executors are
shipped by value, so that the folder need not be installed there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
