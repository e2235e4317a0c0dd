"""Wakeline: vessel-survey and capture/re-sight analytics on PySpark DataFrames."""
