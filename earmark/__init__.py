"""earmark: retrieval evaluation and corpus curation as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

from earmark.session import build_session

# Batch functions travel to the executors by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session"]
