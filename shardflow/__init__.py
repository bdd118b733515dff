"""Sharded dense arrays and deferred dataflow on PySpark DataFrames."""
