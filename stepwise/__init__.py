"""stepwise: Spark-native analytics for step-by-step reasoning verification.

Every public function takes and returns a ``pyspark.sql.DataFrame`` (or a
``Column``); the work is expressed with built-in Catalyst expressions so it
stays inside whole-stage code generation and scales with the cluster.
"""

import sys

from pyspark import cloudpickle as _cloudpickle

# The few Python functions that run inside tasks (Arrow UDFs, mapInPandas
# bodies) are shipped by value, so executors need no installed copy.
_cloudpickle.register_pickle_by_value(sys.modules[__name__])

from stepwise.session import get_session, scratch_path  # noqa: E402

__all__ = ["get_session", "scratch_path"]
