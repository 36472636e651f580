"""Operators for large-scale training data."""

import os
import sys

from pyspark import cloudpickle

# Where PYTHONPATH doesn't lead Python workers to this package, its functions
# travel with the tasks instead.
_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
if _ROOT not in [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]:
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
