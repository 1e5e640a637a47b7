"""Peer-relative screening, scoring and time-series analytics on PySpark DataFrames."""
