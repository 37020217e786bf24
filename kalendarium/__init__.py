"""Calendar-event aggregation on Spark: extraction, merge, resolution, listings, health, visits.

Every operator is a lazy ``DataFrame -> DataFrame`` function; ``now`` is always an argument.
"""

import sys

from pyspark import cloudpickle

# ship the package's vectorized functions with the tasks: workers need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
