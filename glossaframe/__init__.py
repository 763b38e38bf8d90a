"""Numeric and semantic questions over large tables, on Spark."""

import sys

from pyspark import cloudpickle

from .session import configure, local_session
from .workspace import Workspace

# functions that run inside tasks travel with the task, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Workspace", "configure", "local_session"]
