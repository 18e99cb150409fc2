"""Haplotype phasing and genotype imputation as Spark DataFrame programs."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions shipped to executors carry their own code, so that workers need no installed copy of the package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
