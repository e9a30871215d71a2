"""tidecorpus: social-text corpus preparation, subword vocabulary, encoding,
labelled-set preparation and evaluation statistics as Spark DataFrame jobs."""

import sys as _sys

__version__ = "0.1.0"

# Ship the package's Python helpers (Arrow UDFs) by value inside each task, so
# executors need no installed copy of the package.
try:
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle without the API
    pass
