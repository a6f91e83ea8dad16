"""Voxel time-series parcellation on PySpark: similarity graphs, clustering, consensus and metrics as DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
