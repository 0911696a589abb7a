"""Operators for training-data pipelines over documents, pages and embeddings.

Code that runs inside tasks is shipped with them, so executors need no
installed copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
