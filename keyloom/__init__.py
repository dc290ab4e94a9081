"""keyloom: content-addressed data on Spark - identities, indexes, reference graphs, trees, chunks and change tracking."""

import sys

from pyspark import cloudpickle

# Executors get the functions of this package inside their tasks, so they need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
