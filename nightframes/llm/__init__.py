"""Training-data operators over tables of documents.

The functions that run inside Python workers are sent to them by value, so executors need
the installed libraries but no copy of this package.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
