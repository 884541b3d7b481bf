"""Set-evidence analytics on Spark: DataFrame-in / DataFrame-out operators."""
import sys

from pyspark import cloudpickle

# functions handed to applyInPandas / mapInPandas travel by value, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
