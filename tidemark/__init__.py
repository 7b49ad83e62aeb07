"""Tidemark: warehouse loading, hierarchy, calendar and run-log analytics on Spark.

Every operator takes DataFrames (or Columns) and returns DataFrames (or Columns).
"""
