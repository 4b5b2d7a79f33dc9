"""riskscope: Spark-native text moderation analytics."""

import sys as _sys

# Functions handed to Python workers (mapInPandas, applyInPandasWithState)
# are pickled by value, so executors need no installed copy of the package.
try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle without the hook
    pass
