"""Transaction-risk analytics on Spark."""

import sys as _sys

try:
    # Ship this package's code with every Python UDF by value, so executors
    # need no installed copy of it (and notebooks/drivers may live anywhere).
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - pyspark always bundles cloudpickle
    pass
