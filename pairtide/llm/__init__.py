"""Training-data operators: filtering, de-duplication, packing and scoring of text corpora.

Nothing outside this subpackage imports it.  Functions that run inside Python
workers are pickled by value, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
