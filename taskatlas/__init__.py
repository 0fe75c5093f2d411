"""taskatlas: measure how labelled documents touch occupational tasks, on Spark.

Every operator is a function from DataFrame to DataFrame (or a Column builder);
see ``functions`` for Column builders, ``operators`` for DataFrame operators,
``sources`` for readers and writers, ``streaming`` for incremental runs and
``plans`` for whole runs and the query catalogue.
"""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel whole, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
