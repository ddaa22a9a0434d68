"""Spark jobs for a document recommendation feed: ingest, embed, rank, summarise, feed back."""

import sys

from pyspark import cloudpickle

# Batch functions travel to the workers with their code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
