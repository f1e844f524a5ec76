"""Conversation-history analytics expressed as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors whole, which needn't have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
