"""Event-signal analytics on PySpark: messages to incidents, daily signals, features and forecasts."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
