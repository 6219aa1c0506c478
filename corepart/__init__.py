"""Split large graphs into parts sharing a core, embed each part, and align the parts."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their own code, so workers need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
