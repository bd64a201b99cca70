"""Implicit-feedback recommendation analytics as Spark jobs.

Every public operator takes DataFrames and returns DataFrames.  Import them from
``tacit.sources``, ``tacit.functions``, ``tacit.operators`` and ``tacit.plans``.
"""

import sys

from pyspark import cloudpickle

# Functions sent to tasks travel with their code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
