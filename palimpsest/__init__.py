"""Document hygiene, text-fingerprint analytics and document conversion as Spark DataFrame operators."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Executors need no installed copy of this package: functions sent to Python workers travel by value.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
