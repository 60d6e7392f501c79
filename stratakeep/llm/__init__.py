"""Corpus operators for training-data pipelines; nothing outside this subpackage imports it."""

import sys

from pyspark import cloudpickle

# Executors get this subpackage's functions with the task, so workers need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
