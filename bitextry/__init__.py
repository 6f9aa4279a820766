"""Spark-native engine for translation and summarization corpora."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Executors need not have this package installed: its functions travel inside the UDFs that use them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
