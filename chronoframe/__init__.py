"""chronoframe — Spark-native event and time-series analytics operators.

Every operator is a lazily evaluated ``DataFrame -> DataFrame`` function
built from Spark SQL expressions; see ``operators``, ``sources``,
``streaming`` and the registered driver queries in ``plans``.
"""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# functions that run in Python workers are shipped by value: executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
