"""Entity-level event analytics on Spark: sessions, rollups, joins, features, models, scoring."""

import sys

from pyspark import cloudpickle

__all__ = ["functions", "operators", "plans", "sources", "streaming"]

# Functions sent to Python workers travel whole, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
