"""Operators of a training-data pipeline: deduplication, quality, scoring,
tokenising, packing and archiving, each as Spark jobs over whole tables.

Functions of this subpackage run inside Python workers. They are shipped by
value, so executors need no installed copy of the package."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
