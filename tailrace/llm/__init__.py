"""Operators for training corpora: deduplication, decontamination, filtering, mixing, sharding.

Functions that run inside tasks travel with the job, so that executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
