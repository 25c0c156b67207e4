"""Operators for preparing large training corpora on Spark.

Every operator takes and returns DataFrames, selects the columns it needs by
name (further columns never clash with its own) and defines a result for nulls,
empty texts, repeated rows and empty tables.  Nothing else in the library
imports this subpackage.
"""
