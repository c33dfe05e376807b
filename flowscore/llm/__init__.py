"""Training-data operators: tokens, leaks, surrogates, languages, copies, archives, search."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Tasks get the code of this subpackage with the job: executors need no copy of it.
register_pickle_by_value(sys.modules[__name__])
