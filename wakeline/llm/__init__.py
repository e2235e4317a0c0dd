"""Training-data operators. Tasks carry this package's code with them, so workers need no copy of it."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
