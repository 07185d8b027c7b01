"""Posterior-chain and binned-event analytics as plain PySpark functions.

Every operator takes and returns DataFrames (or Columns).  What is held on the
driver is bounded by the number of parameters, histogram bins or configuration
records, never by rows.
"""
