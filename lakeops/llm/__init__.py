"""Operators of a training-data pipeline: each a function from DataFrames to DataFrames.

Only ``doc_id``, ``text`` and, where named, ``source`` are read from an input, so
further columns, whatever their names, never clash. NULL text counts as empty.

Functions that run in tasks are sent with the plan, so executors need no copy of this
package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
