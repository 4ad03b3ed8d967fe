"""scorelens: score entities against a binary label and explain the scores, on Spark.

Every operator is a function ``DataFrame -> DataFrame`` built from Spark SQL
expressions, joins, windows and group-bys; models come from Spark ML.
"""

import sys as _sys

try:  # ship the few Python task functions (grouped pandas steps) by value,
    # so executors need no installed copy of this package
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle
    pass

from scorelens.session import get_spark, scratch_path  # noqa: E402

__all__ = ["get_spark", "scratch_path"]
