"""gridloom: grid analytics and corpus preparation as plain Spark DataFrame plans."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions shipped to executors travel by value, so the package needs no installation there.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
