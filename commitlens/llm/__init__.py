"""Operators for the text of a training corpus.

Nothing else in the library imports this subpackage.  Functions that run inside
Spark's Python workers are sent by value, so workers need no copy of the library.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
