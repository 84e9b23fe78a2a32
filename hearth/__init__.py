"""Household ledger analytics on Spark: DataFrames in, DataFrames out."""

import sys

from pyspark import cloudpickle

# Folds run inside tasks: ship their code with the job, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
