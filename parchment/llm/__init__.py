"""Operators for large training corpora.

Functions that run on executors are shipped by value, so a cluster needs no
copy of this package on its workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
