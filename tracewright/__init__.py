"""A PySpark-native engine for analysing digital-evidence tables.

Layers: ``functions`` (Column -> Column), ``operators`` (DataFrame -> DataFrame), ``sources`` (readers and sinks),
``plans`` (whole analyses and the registered queries), ``streaming`` (the same operators over unbounded input) and the
optional subpackage ``llm`` (text preparation), which nothing else here imports.
"""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the workers by value, so executors need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
