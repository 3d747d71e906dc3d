"""Conditioned-label evaluation on Spark.

Everything here takes and returns DataFrames (or Columns) and is lazy, apart
from the writers in ``sources`` and the run loops in ``operators.batch``.
"""
