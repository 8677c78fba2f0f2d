"""Operators for training data: texts in, decisions about texts out.

Each module holds one operator with a general interface; ``queries`` applies them to
the given tables. Nothing outside this folder imports it.
"""

import sys

from pyspark import cloudpickle

# What tasks run goes to them by value, so that workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
