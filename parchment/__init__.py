"""parchment: a PySpark engine for preparing, checking and auditing long-form text.

Functions that run on executors are shipped by value, so a cluster's workers
need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
