"""tessera: retrieval-training data work as Spark DataFrame jobs."""

import sys

# Ship the library's functions to Python workers by value, so executors need
# no installed copy of this package (UDFs, mapInPandas/applyInPandas bodies
# and their helpers travel inside the task closures).
try:
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(sys.modules[__name__])
except Exception:  # noqa: BLE001 - older cloudpickle: fall back to addPyFile
    pass
