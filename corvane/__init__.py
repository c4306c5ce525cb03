"""Corpus, retrieval and governance analytics as Spark jobs.

Functions that run in Python workers are sent by value, so executors need no
installed copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
