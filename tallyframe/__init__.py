"""Table preparation and two-table reconciliation as lazy Spark plans."""

import sys

from pyspark import cloudpickle

# The few functions that run in Python workers travel with the plan, so executors need no copy of
# this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from tallyframe.operators import (
    charts,
    clean,
    columns,
    conformance,
    edits,
    formatting,
    grouping,
    joins,
    predicates,
    profile,
    reconcile,
    sorting,
    typing,
    unions,
)

__all__ = [
    "charts", "clean", "columns", "conformance", "edits", "formatting", "grouping", "joins",
    "predicates", "profile", "reconcile", "sorting", "typing", "unions",
]
