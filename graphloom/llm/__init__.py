"""Training-data operators: privacy, duplication, contamination, quality, packing and archives.

Nothing outside this subpackage imports it.  Functions that run on Python workers are pickled by value, so a
cluster needs no copy of the package on its executors.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
