"""quillspark: a Spark-first engine for text corpora, retrieval and evaluation analytics.

Importing the package asks PySpark's cloudpickle to ship functions of this package by value, so a
cluster's Python workers need no copy of the package on their import path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
