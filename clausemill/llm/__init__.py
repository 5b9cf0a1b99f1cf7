"""Training-data pipeline operators. Nothing outside this folder (and corpus_pipeline.py) imports it.

Functions of this package travel to the executors by value, so workers need no copy of the package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
