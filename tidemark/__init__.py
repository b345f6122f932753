"""PySpark-native mobility analytics: wide hour tables, statistics and models over event-level Parquet."""

import os
import sys

from pyspark import cloudpickle

os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")  # the driver solves small systems; threads only stall them
cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package on their path
