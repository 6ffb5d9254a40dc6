"""Training-data operators: dedup, filters, scoring, packing and scans over documents and pages.

Nothing else in the library imports this subpackage.
"""

import sys

from pyspark import cloudpickle

# executors get this subpackage's functions with the task and need not have it installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
