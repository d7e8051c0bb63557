"""DataFrame operators for harvested catalogues: search, history, audit, planning."""

import sys

from pyspark import cloudpickle

# The few Python functions travel to the executors with the plan, so the package need not
# be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
