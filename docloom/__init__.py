"""Document-structure analytics on Spark: DataFrame operators over documents, blocks and elements."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel with the job, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
