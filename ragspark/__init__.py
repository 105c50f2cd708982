"""ragspark: retrieval and recommendation operators over tables of queries, texts, vectors and catalogs.

Every operator is a ``DataFrame -> DataFrame`` function keyed by ``query_id`` (or another key column), so one
plan serves a whole table of queries.
"""

import sys

from pyspark import cloudpickle

# Helpers that run in Python workers travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
