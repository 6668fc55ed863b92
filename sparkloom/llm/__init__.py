"""Operators of a training-data pipeline: deduplication, language, toxicity, quality, mixing, tokens, search, pages."""

import sys

from pyspark import cloudpickle

# Worker functions travel by value, so executors need not have this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
