"""Operations for large-scale training data: ten operators over text and vectors, and their queries.

Functions of this package travel to the executors by value, so these need only the third-party libraries installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
