"""segstats: segmentation statistics as Spark jobs.

Rasters are tables (pixels or runs keyed by ``image_id``), every operator maps
DataFrames to DataFrames, and Spark partitions, shuffles and aggregates the work.
"""

import sys

from pyspark import cloudpickle

# Small task-side helpers travel by value, so the package does not have to be
# installed on every executor.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
