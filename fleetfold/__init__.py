"""Map/reduce analytics over vehicle status streams, declared as Spark plans."""

import sys

from pyspark import cloudpickle

from fleetfold.plans.catalog import named_query, query_names
from fleetfold.plans.functions import FunctionQuery
from fleetfold.plans.spec import MapReduceQuery
from fleetfold.schema import MEMBERSHIP, READING, REGION, STATUS

# Executors need no copy of this package: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = [
    "MEMBERSHIP",
    "READING",
    "REGION",
    "STATUS",
    "FunctionQuery",
    "MapReduceQuery",
    "named_query",
    "query_names",
]
