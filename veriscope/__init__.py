"""veriscope: audit text classifiers with Spark DataFrames.

The library reads a labelled corpus and any number of models' predictions,
and answers where, how often and on which texts the models fail.
"""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel by value: the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
