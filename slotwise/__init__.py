"""Entity time-series analytics on Spark.

Operators are plain functions from DataFrames to DataFrames.  Column roles (id, time, code,
value, label) are parameters, so the same operators serve any table of timed, coded
measurements per entity.
"""
