"""Operators that prepare text corpora for model training.

Nothing else in the library imports this subpackage. Its worker functions travel by value, so executors
need the public libraries only, not this repository on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
