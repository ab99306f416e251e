"""Steward: governed tabular data on Spark.

Every operator takes and returns DataFrames; see README.md for the map.
"""
