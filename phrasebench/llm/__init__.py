"""Operators for building training corpora, with their registered queries and check SQL."""

import sys

from pyspark import cloudpickle

# functions for Python workers travel with the tasks, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from phrasebench.llm.queries import ORACLES, QUERIES  # noqa: E402

__all__ = ["QUERIES", "ORACLES"]
