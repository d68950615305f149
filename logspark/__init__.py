"""logspark: log analytics as Spark DataFrame transformations.

Functions return Columns, operators take and return DataFrames, plans chain operators
into whole jobs. Nothing here runs a Spark action unless its docstring says so.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their code: executors need no copy of
# this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
