"""Operators for preparing training text. Nothing else in the library imports this package.

Functions of this package that run in tasks travel with the job, so executors need no installation.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
