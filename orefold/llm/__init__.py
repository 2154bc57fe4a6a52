"""Operators that prepare text for training: extraction, filters, deduplication, mixing.

Nothing outside this subpackage imports it.
"""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with their code, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules["orefold"])
