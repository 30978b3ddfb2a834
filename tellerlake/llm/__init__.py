"""Operators that prepare text corpora for language-model training."""

import sys

from pyspark import cloudpickle

# What runs in tasks travels with its code: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
