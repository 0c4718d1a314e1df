"""Price quotes for second-hand goods as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

from pricetide.session import build_session, tune

__all__ = ["build_session", "tune"]

# Python functions of this package travel to executors whole, so these need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
