"""Operators for training-data pipelines: language, tokens, secrets, licences, copies, mixing."""

import sys

from pyspark import cloudpickle

# Tasks carry the functions of this package with them, so workers need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
