"""fathom: echogram and dive-log analytics expressed as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with the task, so workers need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
