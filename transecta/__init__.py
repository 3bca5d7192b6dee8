"""Transecta: held-out-unit transfer analytics expressed as Spark DataFrame operators."""

from pyspark import cloudpickle

from . import functions, operators, plans, sources, streaming

# What tasks run travels with them, so that executors need no copy of these packages.
for _package in (functions, operators, plans, sources, streaming):
    cloudpickle.register_pickle_by_value(_package)
