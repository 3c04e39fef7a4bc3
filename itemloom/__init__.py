"""Dataset quality, splitting, curation and prediction evaluation on Spark DataFrames."""

import sys

from pyspark import cloudpickle

CHOICES = ("a", "b", "c", "d")

# Functions run inside Python workers travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
