"""spanveil: find, settle, mask and score personal data in Spark tables and streams of text."""

import sys

from pyspark import cloudpickle

# Functions used in tasks travel with the job; executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
